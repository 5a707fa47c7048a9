"""Interactive queries over exported events: filter, sort, page, count, cluster on a map, search facilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.functions import geo
from emberflow.operators.clustering import numbered

SEARCHED = ("event_id", "event_uid", "site_id", "nearest_facility_name", "nearest_facility_id", "context_label", "source_context", "score_status", "decision")
# Days of the presets, and the offset of the local zone for whole local days.
PRESETS = {"day": 1, "week": 7, "month": 30, "year": 365}
LOCAL_OFFSET_MINUTES = 330
CLUSTER_PIXELS, CLUSTER_BELOW_ZOOM, CLUSTER_OVER = 25, 11, 1200


@dataclass(frozen=True)
class Span:
    """A closed span of time; None is unbounded."""

    start: str | None = None
    end: str | None = None


def window(preset: str, now: str, first: str | None = None, last: str | None = None, latest: str | None = None) -> Span:
    """The span of a preset that ends at ``now`` (or at ``latest`` in a replay), or of whole local days for ``custom``."""
    from datetime import datetime, timedelta

    if preset == "all":
        return Span()
    if preset == "custom":
        a, b = (datetime.strptime(x or "", "%Y-%m-%d") for x in (first, last))
        if a > b:
            raise ValueError("the first day lies behind the last")
        shift = timedelta(minutes=LOCAL_OFFSET_MINUTES)
        return Span(str(a - shift), str(b - shift + timedelta(days=1) - timedelta(milliseconds=1)))
    end = datetime.fromisoformat(latest or now)
    return Span(str(end - timedelta(days=PRESETS.get(preset, 1))), str(end))


@dataclass(frozen=True)
class Filter:
    decision: str = "all"
    availability: str = "all"
    min_score: float = 0.0
    query: str = ""
    span: Span = Span()


def overlaps(span: Span) -> Column:
    """Events that meet the span; one missing end stands for the other, undated ones only meet the unbounded span."""
    if span.start is None and span.end is None:
        return F.lit(True)
    start, end = F.coalesce("start_time", "end_time"), F.coalesce("end_time", "start_time")
    out = start.isNotNull()
    if span.start is not None:
        out &= end >= F.lit(span.start).cast("timestamp_ntz")
    if span.end is not None:
        out &= start <= F.lit(span.end).cast("timestamp_ntz")
    return F.coalesce(out, F.lit(False))


def search(events: DataFrame, f: Filter) -> DataFrame:
    """Events that pass all parts of the filter; events without a score pass any least score."""
    out = events
    if f.decision != "all":
        out = out.where(F.col("decision") == f.decision)
    if f.availability in ("scored", "unscored"):
        out = out.where(F.col("anomaly_score").isNotNull() if f.availability == "scored" else F.col("anomaly_score").isNull())
    out = out.where(F.col("anomaly_score").isNull() | (F.col("anomaly_score") >= f.min_score)).where(overlaps(f.span))
    q = f.query.strip().lower()
    if q:
        have = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in SEARCHED if c in events.columns]
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *have)), F.lit(q)))
    return out


def ordered(events: DataFrame, by: str = "latest") -> list[Column]:
    first = {"latest": F.col("start_time").desc_nulls_last(), "score": F.coalesce("anomaly_score", F.lit(-1.0)).desc(), "detections": F.coalesce("detection_count", F.lit(0)).desc()}[by]
    return [first, F.col("event_id").asc()]


def page(events: DataFrame, by: str = "latest", number: int = 0, size: int = 60) -> DataFrame:
    out = events.orderBy(*ordered(events, by))
    return (out.offset(number * size) if number else out).limit(size)


def headline(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count("anomaly_score").alias("scored"), F.count_if(F.col("anomaly_score").isNull()).alias("unscored"), F.count_if(F.col("decision").startswith("suspected_")).alias("suspected"), F.min("start_time").alias("first"), F.max(F.greatest("start_time", "end_time")).alias("last"))


def time_span(events: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """(first, last): the audit's date_min and date_max (text or times) where they can be read, else the extremes of starts and ends."""
    own = events.agg(F.min(F.least("start_time", "end_time")).alias("own_first"), F.max(F.greatest("start_time", "end_time")).alias("own_last"))
    if audit is None:
        return own.select(F.col("own_first").alias("first"), F.col("own_last").alias("last"))
    told = audit.agg(F.min(lenient_time(F.col("date_min").cast("string"))).alias("a"), F.max(lenient_time(F.col("date_max").cast("string"))).alias("b"))
    return own.join(F.broadcast(told)).select(F.coalesce("a", "own_first").alias("first"), F.coalesce("b", "own_last").alias("last"))  # a row each


def valid_points(events: DataFrame) -> DataFrame:
    return events.where(geo.valid_coordinates(F.col("latitude"), F.col("longitude")))


def map_clusters(events: DataFrame, zoom: int, pixels: int = CLUSTER_PIXELS) -> DataFrame:
    """Counts and mean positions by map cell and decision. Whether to cluster at all is ``clusters_wanted``'s matter."""
    x, y = geo.mercator_x(F.col("longitude"), zoom), geo.mercator_y(F.col("latitude"), zoom)
    return valid_points(events).groupBy(F.floor(x / pixels).alias("cell_x"), F.floor(y / pixels).alias("cell_y"), "decision").agg(F.count("*").alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def clusters_wanted(zoom: int, n: int) -> bool:
    return zoom < CLUSTER_BELOW_ZOOM and n > CLUSTER_OVER


def facility_search(facilities: DataFrame, query: str, limit: int = 40) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "name", "kind", "facility_id"))
    return facilities.where(F.contains(hay, F.lit(query.strip().lower()))).orderBy("name", "facility_id").limit(limit)


def score_band(score: Column) -> Column:
    """The label shown for a score."""
    return F.when(score.isNull(), "Insufficient data").when(score >= 0.99, "Highest priority").when(score >= 0.95, "High priority").when(score >= 0.8, "Moderate priority").otherwise("Lower priority")


def comparison(events: DataFrame) -> DataFrame:
    """(event_id, comparison, comparison_references): the population that explains an event's score, or its lack."""
    peer = (F.col("score_method") == "vegetation_peer") | (F.coalesce(F.col("peer_status"), F.lit("not_applicable")) != "not_applicable") & F.col("anomaly_score").isNull()
    peer = F.coalesce(peer, F.lit(False))
    return events.select("event_id", F.when(peer, "Vegetation peers").otherwise("Same-site history").alias("comparison"), F.when(peer, F.col("peer_reference_count")).otherwise(F.col("history_event_count")).alias("comparison_references"))


def imagery_numbers_allowed(status: Column, radiometry: Column) -> Column:
    return F.coalesce((status == "analysed") & (F.coalesce(radiometry, F.lit("")) != "legacy_offset_unverified"), F.lit(False))


def lenient_time(c: Column) -> Column:
    """A time from text; without a zone it is UTC."""
    t = F.trim(c)
    zone = t.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$")
    return F.when(zone, F.to_utc_timestamp(t.try_cast("timestamp"), "UTC").cast("timestamp_ntz")).otherwise(t.try_cast("timestamp_ntz"))


def shards(events: DataFrame, size: int = 256) -> DataFrame:
    """Events with the shard and the place in it, in order of their identifiers."""
    n = F.col("_number")
    return numbered(events, "event_id", name="_number").withColumns({"shard": F.floor(n / size), "shard_index": n % size}).drop("_number")


SUMMARY = ("event_id", "site_id", "start_time", "end_time", "latitude", "longitude", "context_label", "source_context", "decision", "anomaly_score", "score_status", "review_priority", "detection_count", "score_method")


def summary_columns(events: DataFrame) -> DataFrame:
    return events.select(*(c for c in SUMMARY if c in events.columns))


