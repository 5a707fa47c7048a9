"""Roll-ups of detections into snapshots and events, and of events into sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberflow.config import Settings
from emberflow.functions import geo, text, time
from emberflow.operators import clustering

# The order in which platforms stand for an event.
PLATFORM_ORDER = ("VIIRS_SNPP", "VIIRS_NOAA20", "VIIRS_NOAA21", "MODIS_TERRA", "MODIS_AQUA")


def phase(daynight: Column) -> Column:
    p = F.upper(F.coalesce(daynight, F.lit("")))
    return F.when(p.isin("D", "N"), p).otherwise("unknown")


def night(phase_: Column) -> Column:
    return F.when(phase_ == "N", 1.0).when(phase_ == "D", 0.0)


def type2(reference: Column) -> Column:
    return F.when(reference.isNotNull(), (reference == 2).cast("double"))


def snapshots(rows: DataFrame) -> DataFrame:
    """What one sensor saw of an event at one instant: its power (null if no detection has any) and its detections."""
    return rows.groupBy("cluster", "sensor", "phase", "acquired_at").agg(
        F.sum("frp").alias("frp_snapshot"), F.count("frp").alias("frp_valid"), F.count("*").alias("detection_snapshot"),
        F.max("brightness").alias("brightness"), F.max("brightness_temperature_difference").alias("brightness_temperature_difference"),
    )


def snapshot_summary(snaps: DataFrame) -> DataFrame:
    return snaps.groupBy("cluster").agg(
        F.count("*").alias("observation_count"), F.max("frp_snapshot").alias("frp_peak_mw"),
        F.median("frp_snapshot").alias("frp_median_mw"), F.max("detection_snapshot").alias("detection_peak"),
    )


def representative_order() -> list[Column]:
    """Known phases first, then the fixed platform order, then night before day."""
    rank = F.lit(9)
    for i, s in enumerate(PLATFORM_ORDER):
        rank = F.when(F.col("sensor") == s, i).otherwise(rank)
    return [(F.col("phase") == "unknown").cast("int"), rank, F.when(F.col("phase") == "N", 0).when(F.col("phase") == "D", 1).otherwise(2), F.col("sensor")]


def by_kind(snaps: DataFrame) -> DataFrame:
    """Each event's snapshots of one sensor and phase: their number, with the pair's own peak and median power and radiance."""
    return snaps.groupBy("cluster", "sensor", "phase").agg(
        F.count("*").alias("observation_count"), F.max("frp_snapshot").alias("frp_peak_mw"), F.median("frp_snapshot").alias("frp_median_mw"),
        F.max("detection_snapshot").alias("detection_peak"), F.max("brightness").alias("brightness_max"),
        F.max("brightness_temperature_difference").alias("brightness_temperature_difference_max"),
    )


def first_kind() -> Column:
    """Aggregate of ``by_kind``: that of the representative sensor and phase."""
    own = ("frp_peak_mw", "frp_median_mw", "detection_peak", "brightness_max", "brightness_temperature_difference_max")
    return F.min_by(F.struct(F.col("sensor").alias("model_sensor"), F.col("phase").alias("model_daynight"), *own), F.struct(*representative_order()))


def representative(snaps: DataFrame) -> DataFrame:
    """Each event's representative sensor and phase, with peak and median power and radiance of that pair alone."""
    return by_kind(snaps).groupBy("cluster").agg(first_kind().alias("_first")).select("cluster", "_first.*")


def family_peak(family: str) -> Column:
    """Aggregate of the power of snapshots or kinds: the largest one of a family of sensors."""
    viirs = F.coalesce(F.col("sensor").startswith("VIIRS"), F.lit(False))
    return F.max(F.when(viirs if family == "viirs" else ~viirs, F.col("frp_peak_mw"))).alias(f"{family}_frp_peak_mw")


def family_peaks(snaps: DataFrame) -> DataFrame:
    return snaps.withColumnRenamed("frp_snapshot", "frp_peak_mw").groupBy("cluster").agg(family_peak("viirs"), family_peak("modis"))


def rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster").agg(
        F.min("acquired_at").alias("start_time"), F.max("acquired_at").alias("end_time"),
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.count("*").alias("detection_count"),
        F.count_if(F.col("sensor").startswith("VIIRS")).alias("viirs_count"),
        F.count_if(F.col("sensor").startswith("MODIS")).alias("modis_count"),
        F.avg(night(F.col("phase"))).alias("night_fraction"),
        F.avg("confidence_score").alias("confidence_mean"),
        F.avg(type2(F.col("firms_type_reference"))).alias("firms_type_2_reference_fraction"),
        text.set_text(F.col("phase")).alias("detected_daynight"), text.set_text(F.col("sensor")).alias("detected_sensors"),
        text.set_text(F.col("data_quality")).alias("data_quality"),
        content_id("E", F.col("detection_id")).alias("event_id"),
    )


def content_id(prefix: str, member: Column) -> Column:
    """Aggregate: an identifier of a set of members, whatever their order."""
    return text.short_id(prefix, F.concat_ws("|", F.array_sort(F.collect_list(member))))


def spread(rows: DataFrame) -> DataFrame:
    """The largest distance of a detection from its event's mean position."""
    w = Window.partitionBy("cluster")
    far = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.avg("latitude").over(w), F.avg("longitude").over(w))
    return rows.select("cluster", far.alias("d")).groupBy("cluster").agg(F.max("d").alias("spread_km"))


def far_from(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """``spread`` of ``rows`` about the ``centres`` (cluster, latitude, longitude); rows are only compared, not sent, while these are few."""
    centres = clustering.broadcast_if_few(centres.select("cluster", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")))
    far = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    return rows.join(centres, "cluster").groupBy("cluster").agg(F.max(far).alias("spread_km"))


def summarise(rows: DataFrame) -> DataFrame:
    """Events of detections with a ``cluster`` and a ``phase``. ``rows`` are computed three times."""
    kinds = by_kind(snapshots(rows)).groupBy("cluster").agg(
        F.sum("observation_count").alias("observation_count"), F.max("frp_peak_mw").alias("frp_peak_all_sensors_mw"),
        family_peak("viirs"), family_peak("modis"), first_kind().alias("_first"),
    )
    rolled = clustering.checkpointed(rollup(rows))
    out = rolled.join(kinds, "cluster").select("*", "_first.*").drop("_first").join(far_from(rows, rolled), "cluster")
    return out.withColumn("duration_hours", time.hours_between(F.col("start_time"), F.col("end_time")))


def cluster_events(detections: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(detections with event_id, events): density clusters in space and time, cut into episodes of a bounded span.

    A detection's event follows from its cell and its time, so detections are read anew for each step and neither kept nor joined by key.
    """
    m = settings.models
    points = clustering.scaled(detections, m.event_spatial_km, m.event_temporal_hours)
    found = clustering.with_clusters(points, "detection_id", min_samples=m.event_min_samples).drop("x", "y", "t")
    timed = clustering.with_episodes(found, "acquired_at", m.event_temporal_hours)
    rows = timed.withColumns({"cluster": F.struct("component", "start"), "phase": phase(F.col("daynight"))}).drop("component", "start")
    events = clustering.checkpointed(summarise(rows))
    ids = events.select("cluster", "event_id")
    return rows.join(ids, "cluster").drop("cluster", "phase"), events.drop("cluster")


def site_rollup(events: DataFrame) -> DataFrame:
    """Sites of events with a ``site_id``: the centre weighted by detections, days, times, totals and power."""
    w = F.col("detection_count")
    weighted = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    return events.where("site_id <> ''").groupBy("site_id").agg(
        weighted("latitude"), weighted("longitude"), F.count("*").alias("event_count"),
        F.count_distinct(F.to_date("start_time")).alias("active_days"), F.min("start_time").alias("first_seen"),
        F.max("end_time").alias("last_seen"), F.sum("detection_count").alias("total_detections"),
        F.max("frp_peak_mw").alias("frp_peak_mw_max"), F.median("frp_peak_mw").alias("frp_peak_mw_median"),
    )


def site_diameter(events: DataFrame) -> DataFrame:
    """The largest distance between two events of a site. Equal places count once, so a site that recurs in few places stays cheap."""
    places = events.where("site_id <> ''").select("site_id", "latitude", "longitude").distinct()
    a, b = places.alias("a"), places.alias("b")
    far = geo.haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    pairs = a.join(b, (F.col("a.site_id") == F.col("b.site_id")) & (F.struct("a.latitude", "a.longitude") <= F.struct("b.latitude", "b.longitude")))
    return pairs.groupBy(F.col("a.site_id").alias("site_id")).agg(F.max(far).alias("diameter_km"))


def discover_sites(events: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(events with site_id, sites); sites are numbered by their first event's time and identifier, '' is no site."""
    m = settings.models
    members = clustering.site_members(events, m.site_max_diameter_km, m.site_min_events).where("part >= 0")
    timed = members.withColumnRenamed("key", "event_id").join(events.select("event_id", "start_time"), "event_id")
    groups = timed.groupBy("component", "part").agg(F.min(F.struct("start_time", "event_id")).alias("first"))
    numbered = clustering.numbered(groups, "first.start_time", "first.event_id").withColumn("n", F.col("n") + 1).drop("first")
    site_id = F.concat(F.lit("S"), F.when(F.col("n") > 9999, F.col("n").cast("string")).otherwise(F.lpad(F.col("n").cast("string"), 4, "0")))
    named = timed.join(numbered, ["component", "part"]).select("event_id", site_id.alias("site_id"))
    out = clustering.checkpointed(events.drop("site_id").join(named, "event_id", "left").withColumn("site_id", F.coalesce("site_id", F.lit(""))))
    return out, site_rollup(out).join(site_diameter(out), "site_id")
