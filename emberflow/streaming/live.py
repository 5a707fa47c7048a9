"""The streaming face of ingestion: new files, corrected rows, and open episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberflow.config import Settings
from emberflow.operators import ingest


def detection_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 50) -> DataFrame:
    """Raw rows of new CSV files as text. A file whose header differs from the schema stops the stream, rather than
    being read by position; sources with other headers get a stream of their own."""
    df = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option("maxFilesPerTrigger", files_per_trigger).csv(path)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def upsert(target: str, settings: Settings, as_of: str):
    """A function for foreachBatch that merges a batch into a Parquet table of detections, partitioned by day: science quality supersedes
    near real time whenever it comes. Only the days that the batch touches are written again."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = ingest.detections(ingest.judged(batch, settings, as_of)).withColumn("day", F.to_date("acquired_at")).persist()
        try:
            days = [r.day for r in new.select("day").distinct().collect()]  # the days of one batch
            if not days:
                return
            path = spark._jvm.org.apache.hadoop.fs.Path(target)
            exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
            both = spark.read.parquet(target).where(F.col("day").isin(days)).drop("detection_id").unionByName(new) if exists else new
            rows = ingest.deduplicate(both)
            rows = rows.select(ingest.detection_id(*(F.col(c) for c in ingest.DEDUP_KEY)).alias("detection_id"), "*")
            from emberflow.operators.clustering import checkpointed

            checkpointed(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)
        finally:
            new.unpersist()

    return apply


def run(stream: DataFrame, target: str, checkpoint: str, settings: Settings, as_of: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(upsert(target, settings, as_of)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(detections: DataFrame, late: str = "24 hours") -> DataFrame:
    """Detections by hour and sensor; an hour closes once the watermark has passed it."""
    return detections.withWatermark("acquired_at", late).groupBy(F.window("acquired_at", "1 hour"), "sensor").agg(F.count("*").alias("n"), F.sum("frp").alias("frp"))
