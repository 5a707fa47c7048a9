"""Stability of clusterings under subsampling, and the choice of parameters from trials."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.config import Settings
from emberflow.operators.events import cluster_events, discover_sites

# The parameters that are tried.
EVENT_KM, EVENT_HOURS, SITE_KM = (0.75, 1.25, 2.0), (12.0, 24.0, 36.0), (0.75, 1.0, 1.5, 2.0)


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): agreement of two labelings, from the counts of their pairs; 1 for equal partitions."""
    pairs = lambda n: n.cast("double") * (n - 1) / 2
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    one = both.crossJoin(rows).crossJoin(cols)  # one row each
    chance = F.col("sa") * F.col("sb") / F.greatest(pairs(F.col("n")), F.lit(1.0))
    top = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.when(top == chance, 1.0).otherwise((F.col("s") - chance) / (top - chance)).alias("ari"))


def subsample(df: DataFrame, key: str, repeat: int, share: float = 0.8) -> DataFrame:
    """The same share of rows for a repeat, by a hash of the key."""
    return df.where(F.pmod(F.xxhash64(F.lit(repeat), F.col(key)), F.lit(10_000)) < int(share * 10_000))


def trial_statistics(runs: DataFrame, by: list[str], value: str = "ari") -> DataFrame:
    return runs.groupBy(*by).agg(F.avg(value).alias("subsample_ari"), F.min(value).alias("subsample_ari_min"), F.max(value).alias("subsample_ari_max"), F.stddev_pop(value).alias("subsample_ari_std"))


def compliance(events: DataFrame, km: float, hours: float) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return events.agg(F.count("*").alias("events"), share(F.col("detection_count") == 1).alias("singleton_event_fraction"), share(F.col("spread_km") <= 2 * km).alias("spatial_compliance"), share(F.col("duration_hours") <= hours + 1e-9).alias("temporal_compliance"))


def event_objective() -> Column:
    return 0.60 * F.col("subsample_ari") + 0.20 * F.col("spatial_compliance") + 0.20 * (1 - F.col("singleton_event_fraction"))


def site_objective() -> Column:
    return 0.75 * F.col("subsample_ari") + 0.25 * F.col("event_coverage") - 0.03 * (F.col("site_max_diameter_km") / 2.0)


def best(trials: DataFrame, objective: Column, feasible: Column | None = None) -> DataFrame:
    """The feasible trial with the largest objective."""
    rows = trials.where(feasible) if feasible is not None else trials
    columns = F.struct(*rows.columns)
    return rows.withColumn("selection_objective", objective).agg(F.max_by(F.struct(columns.alias("r"), F.col("selection_objective").alias("o")), "selection_objective").alias("x")).select("x.r.*", F.col("x.o").alias("selection_objective"))


def tune_events(detections: DataFrame, settings: Settings) -> DataFrame:
    """A row for each pair of radius and span: agreement with ``tuning_repeats`` subsamples and compliance."""
    spark, out = detections.sparkSession, None
    for km in EVENT_KM:
        for hours in EVENT_HOURS:
            own = replace(settings, models=replace(settings.models, event_spatial_km=km, event_temporal_hours=hours))
            whole, events = cluster_events(detections, own)
            runs = None
            for r in range(settings.models.tuning_repeats):
                part, _ = cluster_events(subsample(detections, "detection_id", r), own)
                both = part.select("detection_id", F.col("event_id").alias("b")).join(whole.select("detection_id", F.col("event_id").alias("a")), "detection_id")
                run = adjusted_rand(both, "a", "b")
                runs = run if runs is None else runs.unionByName(run)
            row = trial_statistics(runs, []).crossJoin(compliance(events, km, hours)).withColumns({"event_spatial_km": F.lit(km), "event_temporal_hours": F.lit(hours)})
            one = spark.createDataFrame(row.collect(), row.schema)  # one row a trial
            out = one if out is None else out.unionByName(one)
    return out


def tune_sites(events: DataFrame, settings: Settings) -> DataFrame:
    """A row for each diameter; events in no site are labelled by themselves."""
    spark, out = events.sparkSession, None
    label = F.when(F.col("site_id") == "", F.col("event_id").cast("string")).otherwise(F.col("site_id"))
    for km in SITE_KM:
        own = replace(settings, models=replace(settings.models, site_max_diameter_km=km))
        whole, sites = discover_sites(events, own)
        runs = None
        for r in range(settings.models.tuning_repeats):
            part, _ = discover_sites(subsample(events, "event_id", r), own)
            both = part.select("event_id", label.alias("b")).join(whole.select("event_id", label.alias("a")), "event_id")
            run = adjusted_rand(both, "a", "b")
            runs = run if runs is None else runs.unionByName(run)
        extra = whole.agg(F.avg((F.col("site_id") != "").cast("double")).alias("event_coverage")).crossJoin(sites.agg(F.count("*").alias("sites"), F.coalesce(F.max("diameter_km"), F.lit(0.0)).alias("observed_max_diameter_km")))
        row = trial_statistics(runs, []).crossJoin(extra).withColumn("site_max_diameter_km", F.lit(km))
        one = spark.createDataFrame(row.collect(), row.schema)
        out = one if out is None else out.unionByName(one)
    return out
