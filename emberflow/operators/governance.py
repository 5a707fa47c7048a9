"""Checks of results: violations, differences between two runs, agreement of key sets, digests, manifests, staged publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def violations(events: DataFrame, key: str = "event_id", expected_rows: int | None = None) -> DataFrame:
    """(rule, subject): missing and repeated identifiers, scores outside [0, 1], a count that differs from the expected."""
    text = F.col(key).cast("string")
    missing = events.where(text.isNull() | (text == "")).select(F.lit("missing_id").alias("rule"), F.lit("").alias("subject"))
    twice = duplicates(events, key).where(F.col(key).isNotNull()).select(F.lit("duplicate_id").alias("rule"), text.alias("subject"))
    score = F.col("anomaly_score")
    wrong = events.where(score.isNotNull() & (F.isnan(score) | ~score.between(0, 1))).select(F.lit("invalid_score").alias("rule"), F.coalesce(text, F.lit("")).alias("subject"))
    out = missing.unionByName(twice).unionByName(wrong)
    if expected_rows is not None:
        n = events.agg(F.count("*").alias("n"))
        out = out.unionByName(n.where(F.col("n") != expected_rows).select(F.lit("row_count").alias("rule"), F.col("n").cast("string").alias("subject")))
    return out


def compare(before: DataFrame, after: DataFrame, key: str = "event_id", fields: tuple[str, ...] = ("decision", "source_context", "site_id"), numbers: tuple[str, ...] = ("anomaly_score",), tolerance: float = 1e-12) -> DataFrame:
    """(measure, n): rows of both, added and removed identifiers, and changes of each field on common ones."""
    pick = lambda df, p: df.select(F.col(key).alias(f"{p}_key"), *(F.col(c).alias(f"{p}_{c}") for c in fields + numbers))
    j = pick(before, "a").join(pick(after, "b"), F.col("a_key") == F.col("b_key"), "full_outer")
    both = F.col("a_key").isNotNull() & F.col("b_key").isNotNull()
    measures = {"reference_events": F.count("a_key"), "rebuilt_events": F.count("b_key"), "added_event_ids": F.count_if(F.col("a_key").isNull()), "removed_event_ids": F.count_if(F.col("b_key").isNull())}
    for c in fields:
        measures[f"changed_{c}"] = F.count_if(both & ~F.coalesce(F.col(f"a_{c}"), F.lit("")).eqNullSafe(F.coalesce(F.col(f"b_{c}"), F.lit(""))))
    for c in numbers:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        measures[f"changed_{c}"] = F.count_if(both & ~(a.isNull() & b.isNull() | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))))
    wide = j.agg(*(v.alias(k) for k, v in measures.items()))
    return wide.unpivot([], list(measures), "measure", "n")


def key_agreement(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(issue, n): keys that only one side has, and common keys whose values differ, null being equal to null."""
    left, right = a.select(F.col(key).alias("k"), F.struct(*values).alias("va")), b.select(F.col(key).alias("k2"), F.struct(*values).alias("vb"))
    j = left.join(right, F.col("k") == F.col("k2"), "full_outer")
    issue = F.when(F.col("k2").isNull(), "only_left").when(F.col("k").isNull(), "only_right").when(~F.col("va").eqNullSafe(F.col("vb")), "different")
    return j.select(issue.alias("issue")).where("issue is not null").groupBy("issue").agg(F.count("*").alias("n"))


def digest(df: DataFrame, key: str, values: list[str], group: str | None = None) -> DataFrame:
    """An order-free digest: rows are hashed, counted and summed, so that nothing has to be in one place."""
    row = F.xxhash64(key, *values)
    g = df.groupBy(group) if group else df
    parts = [F.count("*").alias("rows"), F.sum(F.shiftrightunsigned(row, 33)).alias("a"), F.sum(row.bitwiseAND(F.lit(0x1FFFFFFFF))).alias("b"), F.bit_xor(row).alias("x")]
    return g.agg(*parts).withColumn("digest", F.sha2(F.concat_ws("|", "rows", "a", "b", "x"), 256)).drop("a", "b", "x")


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_errors(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, error): listed twice, missing, unlisted, or of another size or content."""
    twice = duplicates(expected, "path").select("path", F.lit("listed_twice").alias("error"))
    j = expected.select("path", F.col("bytes").alias("eb"), F.col("sha256").alias("es")).join(found.select(F.col("path").alias("fp"), F.col("bytes").alias("fb"), F.col("sha256").alias("fs")), F.col("path") == F.col("fp"), "full_outer")
    error = F.when(F.col("fp").isNull(), "missing").when(F.col("path").isNull(), "unlisted").when(F.col("eb") != F.col("fb"), "size").when(F.col("es") != F.col("fs"), "content")
    return twice.unionByName(j.select(F.coalesce("path", "fp").alias("path"), error.alias("error")).where("error is not null"))


def publish(df: DataFrame, target: str, check=None) -> None:
    """Write to a staging folder, check what was written, and only then take the place of ``target``; on failure the old one stays."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    stage, old = f"{target}.stage-{uuid.uuid4().hex[:8]}", f"{target}.old-{uuid.uuid4().hex[:8]}"
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(stage)
        if check is not None and not (bad := check(spark.read.parquet(stage))).isEmpty():
            raise ValueError(f"the staged result breaks rules: {bad.limit(5).collect()}")
        had = fs.exists(make(target))
        if had and not fs.rename(make(target), make(old)):
            raise OSError(f"{target} can't be set aside")
        if not fs.rename(make(stage), make(target)):
            if had:
                fs.rename(make(old), make(target))
            raise OSError(f"{target} can't be published")
        if had:
            fs.delete(make(old), True)
    finally:
        if fs.exists(make(stage)):
            fs.delete(make(stage), True)
