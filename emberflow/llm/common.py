"""What the training-data operators share: the exchange folder, materialising, and normalisation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch on its way to a worker, and of finished groups that a worker gathers into one batch.
BATCH_BYTES = 4 << 20
#: Spark removes the shuffle files of a query when it ends, instead of when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What makes a key hot, and how many keys can be.
LEAST_HOT, HOT_KEYS = 10_000, 1 << 16
#: Bytes that a task writes of a table between two steps, at most and roughly.
WRITE_BYTES = 32 << 20
_BATCH, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; a session on a cluster is refused, as a
    machine-local folder would not be seen by other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="emberflow-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    atexit.register(_remove, own)
    return f"file://{own}"


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def materialise(df: DataFrame, tag: str, n_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and a lost executor costs
    at most the tasks that were running on it. ``discard`` removes what has no reader left.

    With ``n_bytes``, an upper estimate of its size, it is written by no more tasks than that many bytes need
    (but by twice the cores at least), so that small tables aren't hundreds of files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if n_bytes is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // WRITE_BYTES)))
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Remove tables that ``materialise`` wrote, once all that reads them is written itself."""
    for df in written:
        if path := getattr(df, "_written_to", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes.

    Spark's default of 64 MB a batch is held by the JVM and by the worker at once, so a session that has
    not set ``spark.sql.execution.arrow.maxBytesPerBatch`` itself gets BATCH_BYTES.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) in _DEFAULT_BATCH:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def meet(rows: DataFrame, found: DataFrame, by: list[str], times: str = "times") -> DataFrame:
    """``rows`` with the row of ``found`` that equals them in ``by``; ``times`` of ``found`` tells how many rows that are.

    A key is hot if more than LEAST_HOT rows and more than one row in HOT_KEYS have it, so at most HOT_KEYS keys are. Rows
    of hot keys meet theirs by a broadcast, where they are; those of other keys by a shuffle. Both tables should be written
    ones, as each is read twice.
    """
    most = max(LEAST_HOT, (found.agg(F.sum(F.col(times).cast("double"))).first()[0] or 0) / HOT_KEYS)
    hot = found.where(F.col(times) > most)
    near = rows.join(F.broadcast(hot), by)
    far = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(found.where(F.col(times) <= most), by)
    return near.select(*far.columns).unionByName(far)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, n_bytes: int | None = None, target: int = 32 << 20) -> int:
    """Shuffle partitions: the session's number, or as many as ``n_bytes`` at ``target`` bytes each need."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(own, -(-n_bytes // target)) if n_bytes else own


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``names`` (compared without case)."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def grouped(
    df: DataFrame, by: list[str], schema: T.StructType | str, work: Callable[[pa.Table], pa.RecordBatch | None], partitions: int | None = None
) -> DataFrame:
    """``work`` for each group of ``by``; the groups stream through sorted partitions, one in memory at a time.

    What a group leaves over of a batch is copied, so that no batch stays in memory for a few of its rows, and
    results are handed on by their bytes. ``partitions`` fixes the number of tasks; without it AQE may join some.
    """
    placed = (df.repartition(partitions, *by) if partitions else df.repartition(*by)).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done: list[pa.RecordBatch] = []
        last = None
        size = 0

        def finish() -> int:
            out = work(pa.Table.from_batches(held)) if held else None
            if out is None:
                return 0
            done.append(out)
            return out.nbytes

        for b in batches:
            if b.num_rows == 0:
                continue
            keys = [b.column(c).to_numpy(zero_copy_only=False) for c in by]
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            new[0] = last is not None and tuple(k[0] for k in keys) != last
            last = tuple(k[-1] for k in keys)
            at = 0
            for s in [*np.flatnonzero(new).tolist(), b.num_rows]:
                if s > at:
                    whole = s - at == b.num_rows or s < b.num_rows
                    held.append(b.slice(at, s - at) if whole else b.take(pa.array(np.arange(at, s))))
                if s < b.num_rows:
                    size += finish()
                    held.clear()
                    if size >= BATCH_BYTES or len(done) >= 500:
                        yield from _joined(done)
                        done.clear()
                        size = 0
                at = s
        finish()
        yield from _joined(done)

    return arrow_map(placed, run, schema)


def _joined(done: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(done).combine_chunks().to_batches() if len(done) > 1 else list(done)
