"""Writers: CSV tables, GeoJSON lines and documents, rankings, sharded details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.operators.serving import shards, summary_columns


def csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header; as many as the data has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def strict(c: Column, kind: T.DataType) -> Column:
    """A value as strict JSON has it, at any depth: numbers that aren't finite are null. Times become ISO text in ``to_json``."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: strict(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: strict(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(strict(c.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    return c


def feature(df: DataFrame, key: str) -> Column:
    """A row as GeoJSON text: a point without latitude and longitude among its properties, numbers that aren't finite as null."""
    hidden = {"latitude", "longitude"}
    kept = [strict(quoted(f.name), f.dataType).alias(f.name) for f in df.schema if f.name not in hidden and not f.name.startswith("_")]
    point = F.struct(F.lit("Point").alias("type"), F.array(*(strict(F.col(c), T.DoubleType()) for c in ("longitude", "latitude"))).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), quoted(key).cast("string").alias("id"), point.alias("geometry"), F.struct(*kept).alias("properties")), {"ignoreNullFields": "false"})


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def geojson_lines(df: DataFrame, path: str, key: str) -> None:
    """A feature a line, in as many files as partitions: no task holds the whole collection."""
    df.select(feature(df, key).alias("value")).write.mode("overwrite").text(path)


def collection(df: DataFrame, path: str, key: str, compression: str = "none") -> None:
    """One FeatureCollection in part files, in order of ``key``: joined in the order of their names they are the document.

    Each line but the first feature's begins with its comma, so no task has to hold more than its own range. Joined gzip
    parts are valid gzip, and hold no times, so equal rows give equal bytes. No rows give an empty collection.
    """
    rows = shards(df.select(quoted(key).alias("event_id"), feature(df, key).alias("_line")), 1)
    lines = rows.select(F.lit(1).alias("part"), F.col("shard").alias("n"), F.concat(F.when(F.col("shard") > 0, ",").otherwise(""), "_line").alias("value"))
    ends = df.sparkSession.createDataFrame([(0, 0, '{"type":"FeatureCollection","features":['), (2, 0, "]}")], "part int, n bigint, value string")
    lines.unionByName(ends).orderBy("part", "n").select("value").write.mode("overwrite").option("compression", compression).text(path)


def joined(spark: SparkSession, parts: str, target: str) -> None:
    """The part files of a folder as one file, copied in the order of their names and renamed when it is whole."""
    jvm = spark.sparkContext._jvm
    make, conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs = make(target).getFileSystem(conf)
    source = make(parts).getFileSystem(conf)
    unfinished = make(f"{target}.part")
    out = fs.create(unfinished, True)
    try:
        for status in sorted(source.globStatus(make(parts, "part-*")), key=lambda f: f.getPath().getName()):
            from_ = source.open(status.getPath())
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(from_, out, 1 << 16, False)
            from_.close()
    finally:
        out.close()
    fs.delete(make(target), False)
    if not fs.rename(unfinished, make(target)):
        raise OSError(f"{target} can't be written")


def ranking(events: DataFrame, path: str) -> None:
    events.where("anomaly_score is not null").orderBy(F.col("anomaly_score").desc(), "event_id").write.mode("overwrite").option("header", True).csv(path)


def details(events: DataFrame, path: str, size: int = 256) -> DataFrame:
    """Compressed details by shard, and the summary that names shard and place."""
    dealt = shards(events, size)
    dealt.write.mode("overwrite").partitionBy("shard").option("compression", "gzip").json(path)
    return summary_columns(dealt).join(dealt.select("event_id", "shard", "shard_index"), "event_id")
