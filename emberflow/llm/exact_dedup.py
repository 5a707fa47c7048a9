"""Exact deduplication by content sort.

The normalised texts are range-partitioned at sampled splitters and sorted externally, which places equal
texts next to each other; every text is then compared in full with its neighbour. The sort key is a short
head of the text, a 64-bit value of all of it, the text and the identifier, so the splitters the driver
sees are small however long the texts are, and a text with very many copies is spread over neighbouring
partitions at its identifiers. Runs cut by a partition's edge are joined by their digests afterwards: two
rows a partition at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm.common import arrow_map, ascii_lower, materialise, partitions_for, table

#: Runs at partition edges are broadcast only up to so many; beyond that they are joined by a shuffle.
EDGE_ROWS = 200_000


def runs(df: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "max", partitions: int | None = None) -> DataFrame:
    """One row for each run of equal normalised texts inside a sorted partition:
    (pid, edge, sha, n, last, ids); ``ids`` are sorted so that the one to keep is the last."""
    spark = df.sparkSession
    low = df.select(F.col(key).alias("id"), ascii_lower(F.col(text)).alias("norm"))
    keyed = low.select("id", "norm", F.substring("norm", 1, 16).alias("head"), F.xxhash64("norm").alias("h"))
    order = F.col("id").asc_nulls_first() if keep == "max" else F.col("id").desc_nulls_first()
    ranged = keyed.repartitionByRange(partitions or partitions_for(spark), "head", "h", order)
    placed = ranged.sortWithinPartitions("head", "h", "norm", order).select("id", "norm", F.sha2("norm", 256).alias("sha"))
    kind = low.schema["id"].dataType
    schema = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("edge", T.BooleanType()), T.StructField("sha", T.StringType()), T.StructField("n", T.LongType()), T.StructField("last", kind), T.StructField("ids", T.ArrayType(kind))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first = TaskContext.get().partitionId(), True
        text_before, sha, ids = None, None, []

        def rows(done: list[tuple[bool, str, list]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pid] * len(done), pa.int32()), pa.array([x[0] for x in done], pa.bool_()), pa.array([x[1] for x in done], pa.string()), pa.array([len(x[2]) for x in done], pa.int64()), pa.array([x[2][-1] for x in done]).cast(id_type), pa.array([x[2] for x in done], pa.list_(id_type))], ["pid", "edge", "sha", "n", "last", "ids"])

        id_type = None
        for b in batches:
            if b.num_rows == 0:
                continue
            id_type = b.schema.field("id").type
            norm, m = b.column("norm"), b.num_rows
            starts = np.flatnonzero(~np.asarray(pc.equal(norm.slice(1), norm.slice(0, m - 1)).to_numpy(zero_copy_only=False), bool)) + 1 if m > 1 else np.zeros(0, np.int64)
            if text_before is None or norm[0].as_py() != text_before:
                starts = np.concatenate([[0], starts])
            some, shas, done = b.column("id").to_pylist(), b.column("sha"), []
            at = 0
            for s in starts.tolist():
                ids += some[at:s]
                if ids:
                    done.append((first, sha, ids))
                    first, ids = False, []
                sha, at = shas[s].as_py(), s
            ids += some[at:]
            text_before = norm[m - 1].as_py()
            if done:
                yield rows(done)
        if ids:
            yield rows([(True, sha, ids)])

    return arrow_map(placed, scan, schema)


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "max", partitions: int | None = None) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z: (``key``, keep_id, group_size, kept, text_sha256), a row for each input row.

    ``keep`` is ``max`` or ``min``: the row with the largest or the smallest identifier stays. Null texts
    count as empty, so all null and empty texts are one group. Null identifiers come behind all others, so
    such a row stays only if its group has no other. Of rows that repeat an identifier and a text, exactly
    one is kept. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    found = materialise(runs(df, text, key, keep, partitions), "exact-runs")
    edges = found.where("edge").groupBy("sha").agg(F.sum("n").alias("size"), F.max(F.struct("pid", "last")).alias("top"))
    if found.select(F.max("pid")).first()[0] is not None and found.where("edge").limit(EDGE_ROWS + 1).count() <= EDGE_ROWS:
        edges = F.broadcast(edges)
    joined = found.join(edges, "sha", "left")
    whole = joined.select("sha", "ids", F.coalesce("size", "n").alias("size"), F.coalesce("top.last", "last").alias("keep_id"), (F.col("top").isNull() | (F.col("top.pid") == F.col("pid"))).alias("mine"))
    return whole.select("sha", "size", "keep_id", "mine", F.posexplode("ids").alias("at", "id"), (F.size("ids") - 1).alias("end")).select(F.col("id").alias(key), "keep_id", F.col("size").alias("group_size"), (F.col("mine") & (F.col("at") == F.col("end"))).alias("kept"), F.col("sha").alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       row_number() over (partition by norm order by doc_id desc) = 1 as kept, sha256(norm) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
window w as (partition by norm)
"""
QUERIES, SQL = {"op1_exact_dedup": op1_exact_dedup}, {"op1_exact_dedup": ORACLE}
