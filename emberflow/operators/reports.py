"""The data behind reports: pipeline counts, months, decisions, histograms, stability, and agreement with silver references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rows and columns of the silver matrix.
SILVER_ROWS = ("Static source (Type 2)", "Vegetation (Type 0)")
SILVER_COLUMNS = ("Industrial", "Vegetation", "Abstain / mixed")


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def monthly(detections: DataFrame, sensors: list[str]) -> DataFrame:
    """Detections by month, a column a sensor, zero where there are none."""
    month = F.date_format("acquired_at", "yyyy-MM")
    return detections.groupBy(month.alias("month")).pivot("sensor", sensors).count().na.fill(0)


def shares(events: DataFrame, column: str = "decision") -> DataFrame:
    """(value, n, percent); the total is a one-row join, not a window over everything."""
    counts = events.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select("value", "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def score_histogram(events: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n) of scores in [0, 1]; the last bin is closed, -1 counts events without a score."""
    b = F.when(F.col("anomaly_score").isNull(), -1).otherwise(F.least(F.floor(F.col("anomaly_score") * bins), F.lit(bins - 1)))
    return events.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def stability(trials: DataFrame, rows: str, columns: str, values: list[float]) -> DataFrame:
    """The best agreement for each pair of two parameters, as a table."""
    return trials.groupBy(rows).pivot(columns, values).agg(F.max("subsample_ari"))


def silver(detections: DataFrame, min_refs: int = 2, purity: float = 0.8) -> DataFrame:
    """(event_id, silver): events whose referenced detections are enough and agree."""
    refs = detections.where(F.col("firms_type_reference").isin(0, 2))
    g = refs.groupBy("event_id").agg(F.count("*").alias("n"), F.avg((F.col("firms_type_reference") == 2).cast("double")).alias("t2"))
    label = F.when(F.col("t2") >= purity, SILVER_ROWS[0]).when(1 - F.col("t2") >= purity, SILVER_ROWS[1])
    return g.where(F.col("n") >= min_refs).select("event_id", label.alias("silver")).where("silver is not null")


def predicted(label: Column) -> Column:
    return F.when(label == "industrial_associated", SILVER_COLUMNS[0]).when(label == "vegetation_associated", SILVER_COLUMNS[1]).otherwise(SILVER_COLUMNS[2])


def silver_matrix(events: DataFrame, detections: DataFrame) -> DataFrame:
    """Silver references against predictions, all rows and columns, zero where there are none."""
    spark = events.sparkSession
    found = events.select("event_id", predicted(F.col("context_label")).alias("p")).dropDuplicates(["event_id"]).join(silver(detections), "event_id")
    table = found.groupBy("silver").pivot("p", list(SILVER_COLUMNS)).count()
    rows = spark.createDataFrame([(r,) for r in SILVER_ROWS], "silver string")
    return rows.join(table, "silver", "left").na.fill(0).withColumnsRenamed({"Industrial": "industrial", "Vegetation": "vegetation", "Abstain / mixed": "abstain"})


def summary(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.min("start_time").alias("first"), F.max("end_time").alias("last"), F.median("anomaly_score").alias("median_score"), F.count("anomaly_score").alias("scored"), F.avg(F.col("anomaly_score").isNotNull().cast("double")).alias("coverage"))


def freshness(detections: DataFrame, as_of: str, hours: float = 24) -> DataFrame:
    """The latest detection and near-real-time detection, and whether the latter is fresh."""
    live = F.max(F.when(F.col("data_quality") == "near_real_time", F.col("acquired_at")))
    age = F.timestamp_diff("MICROSECOND", F.col("latest_live"), F.lit(as_of).cast("timestamp_ntz")) / 3.6e9
    out = detections.agg(F.max("acquired_at").alias("latest"), live.alias("latest_live"), F.count_if(F.col("data_quality") == "near_real_time").alias("live_rows"))
    return out.withColumns({"age_hours": age, "status": F.when(age <= hours, "fresh").otherwise("stale")})


def coverage_note(missing: DataFrame) -> DataFrame:
    """(note): a sentence with the missing years."""
    years = missing.agg(F.concat_ws(", ", F.array_sort(F.collect_set(F.col("year").cast("string")))).alias("y"))
    rest = F.lit("Coverage has gaps; where nothing was observed, fires may have been.")
    return years.select(F.when(F.col("y") == "", rest).otherwise(F.concat(F.lit("Missing years: "), F.col("y"), F.lit(". "), rest)).alias("note"))
