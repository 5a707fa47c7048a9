"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of bigrams and words with a uniform share, by weights that
depend on how often the context was seen (a bucket for each power of two). Expectation-maximisation learns the
weights on a held-out tenth of the training documents, with the counts of the others; then all training
documents are counted for the scores.

Counts are exchanged, not texts or single n-grams. Documents are dealt to blocks of a bounded size. A block
sends its distinct n-grams once, as sorted arrays cut into ranges of the key space; whoever owns a range
adds all blocks' counts and answers each block with the totals, in the order of the block's own keys, so
answers carry no keys. Frequent words are pre-aggregated by this, and ranges of 64-bit hashes are even.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm.common import discard, grouped, materialise, partitions_for, table
from emberflow.llm.textkit import U, mix, text_buffer, words

#: UTF-8 bytes of text in a block, and n-grams in a range, both on average; bytes of a task's input in an exchange.
BLOCK_BYTES, RANGE_KEYS, TASK_BYTES = 4 << 20, 1 << 19, 16 << 20
#: The remainder of crc32(identifier) mod 10 that is never learned from, and the one that the weights are learned on.
TEST, DEV = 0, 9
BUCKETS = 42
#: Held-out probabilities are gathered in cells of an eighth of an octave.
STEPS = 8
_BEGIN, _END = (int(x) for x in mix(np.array([0xB0, 0xE0], U)))
_STATS = -(1 << 31)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and the index of each value among them."""
    found, at = np.unique(x, return_inverse=True)
    return found, at.astype(np.int32)


class Block:
    """The tokens of some documents: per token its document, the index of its word, of its context's word and of its bigram."""

    def __init__(self, t: pa.Table):
        data, off = text_buffer(t.column("text"))
        value, _, doc = words(data, off, "nonspace")
        self.n_docs = len(off) - 1
        tok = np.full(len(value) + self.n_docs, U(_END))
        tok[np.arange(len(value)) + doc] = value
        self.length = np.bincount(doc, minlength=self.n_docs) + 1
        self.doc = np.repeat(np.arange(self.n_docs, dtype=np.int32), self.length)
        start = np.cumsum(self.length) - self.length
        ctx = np.concatenate([[U(_BEGIN)], tok[:-1]])
        ctx[start] = U(_BEGIN)
        self.words, self.w = _distinct(tok)
        self.pairs, self.p = _distinct(mix(ctx * U(0x9E3779B97F4A7C15) + tok))
        # each word is followed by one token, so its context count is its own; the begin is seen as often as the end
        self.c = np.concatenate([np.zeros(1, np.int32), self.w[:-1]])
        self.c[start] = np.searchsorted(self.words, U(_END))


def _packed(numbers: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, with that size in front."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes((kind.itemsize,)) + numbers.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _bits(n_bytes: int) -> tuple[int, int]:
    """Bits of the ranges for words and for bigrams, from the bytes of text (six a token)."""
    b = max(0, int(np.ceil(np.log2(max(n_bytes / 6 / RANGE_KEYS, 1)))))
    return max(0, b - 2), b


def _requests(t: pa.Table, bits: tuple[int, int]) -> pa.RecordBatch:
    block = Block(t)
    train = np.asarray(t.column("r").to_numpy()) != TEST
    own = train[block.doc]
    at = t.column("block")[0].as_py()
    rows = []
    for order, keys, index in ((1, block.words, block.w), (2, block.pairs, block.p)):
        counts = np.bincount(index[own], minlength=len(keys))
        shift = 64 - bits[order - 1]
        of = (keys >> U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(keys)]  # of the ranges that have keys
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows.append((order, int(of[a]), at, keys[a:b].tobytes(), _packed(counts[a:b])))
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["ord", "p", "block", "keys", "counts"])


_REPLY = "block int, ord int, p int, totals binary, dev binary, n bigint, v bigint, n_dev bigint, v_rest bigint"


def _replies(t: pa.Table) -> pa.RecordBatch:
    blocks = t.column("block").to_pylist()
    keys = [np.frombuffer(x, U) for x in t.column("keys").to_pylist()]
    counts = [_unpacked(x) for x in t.column("counts").to_pylist()]
    order, p = t.column("ord")[0].as_py(), t.column("p")[0].as_py()
    ends = np.cumsum([len(k) for k in keys])
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    flat = np.concatenate(counts)
    is_dev = np.repeat(np.array(blocks) < 0, [len(k) for k in keys])
    total = np.zeros(len(distinct), np.int64)
    dev = np.zeros(len(distinct), np.int64)
    np.add.at(total, index, flat)
    np.add.at(dev, index[is_dev], flat[is_dev])
    rows = []
    for i, b in enumerate(blocks):
        own = index[ends[i] - len(keys[i]) : ends[i]]
        rows.append((b, order, p, _packed(total[own]), _packed(dev[own]) if b < 0 else None, None, None, None, None))
    if order == 1:
        rows.append((_STATS, order, p, None, None, int(total.sum()), int((total > 0).sum()), int(dev.sum()), int((total > dev).sum())))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "ord", "p", "totals", "dev", "n", "v", "n_dev", "v_rest"])


def _answered(t: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The block's totals for its words and its bigrams, from the answers in key order."""
    rows = sorted(zip(t.column("ord").to_pylist(), t.column("p").to_pylist(), t.column(column).to_pylist(), strict=True), key=lambda r: r[:2])
    return tuple(np.concatenate([_unpacked(r[2]) for r in rows if r[0] == k] or [np.zeros(0, np.int64)]) for k in (1, 2))


def _split(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    import pyarrow.compute as pc

    docs = pc.is_null(t.column("ord"))
    return t.filter(docs), t.filter(pc.invert(docs))


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one for each power of two."""
    return np.minimum(np.ceil(np.log2(count + 1.0)).astype(np.int64), BUCKETS - 1)


def _estimates(block: Block, uni: np.ndarray, bi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: its context's bucket, and the estimates of its word and its bigram."""
    ctx = uni[block.c]
    p1 = uni[block.w] / max(n, 1)
    p2 = bi[block.p] / np.maximum(ctx, 1)
    return bucket_of(ctx), p1, p2


def learn_weights(cells: np.ndarray, floor: float, rounds: int = 100, prior: float = 50.0) -> np.ndarray:
    """Weights (BUCKETS x (bigram, word, uniform)) by expectation-maximisation; ``cells`` are rows (bucket, tokens, p1, p2).

    Each bucket is drawn to the weights over all buckets as by ``prior`` tokens, so buckets without held-out
    tokens have those. The bucket of unseen contexts has no bigram share.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(cells):
        weights[0] = (0, 0.5, 0.5)
        return weights
    b, n = cells[:, 0].astype(np.int64), cells[:, 1]
    p = np.stack([cells[:, 3], cells[:, 2], np.full(len(cells), floor)], 1)
    p[b == 0, 0] = 0
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / share.sum(1))[:, None]
        by = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], 1)
        all_of = by.sum(0) / by.sum()
        weights = (by + prior * all_of) / (by.sum(1, keepdims=True) + prior)
        weights[0, 0] = 0
        weights[0] /= weights[0].sum()
        weights = np.maximum(weights, 1e-9 * np.array([1, 1, 1]))
        weights[0, 0] = 0
        weights /= weights.sum(1, keepdims=True)
    return weights


def lm_score(df: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(``key``, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    Tokens are words between white space, A-Z lower-cased, and one end. A row is held out, and nothing is
    learned from it, if crc32 of its identifier as text is divisible by 10 (a null identifier counts as
    empty text). base_score is the log10 probability under word counts with 0.1 added, score that of the
    model. Null texts are empty and consist of the end alone. With nothing to learn from, each token has the
    share that a vocabulary of one unknown word gives it, so both scores are 0. Words are told apart by 64 bits, so two
    of 10^9 different words share their counts by chance with odds of about 1 to 40. Rows that repeat an identifier and a
    text count as often as they stand there and get the same scores. A long text is one document of one block, whole. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    docs = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(10)).cast("int").alias("r"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    n_dev = max(1, n_blocks // 10)
    spread = F.xxhash64("id", "text")
    block = F.when(F.col("r") == DEV, -1 - F.pmod(spread, F.lit(n_dev))).otherwise(F.pmod(spread, F.lit(n_blocks))).cast("int")
    docs = docs.withColumn("block", block)
    bits = _bits(size)
    tasks = partitions_for(spark, size, TASK_BYTES)
    asked = grouped(docs, ["block"], "ord int, p int, block int, keys binary, counts binary", lambda t: _requests(t, bits), tasks)
    # a range's keys come from all blocks: at most 9 or 10 bytes for each of six bytes of text and order
    answers = materialise(grouped(asked, ["ord", "p"], _REPLY, _replies, 2 * tasks), "lm-answers")
    n, v, n_d, v_rest = (x or 0 for x in answers.where(F.col("block") == _STATS).agg(*(F.sum(c) for c in ("n", "v", "n_dev", "v_rest"))).first())
    rows = answers.where(F.col("block") != _STATS).select("block", "ord", "p", "totals", "dev")

    def met(own: DataFrame, told: DataFrame) -> DataFrame:
        return own.unionByName(told, allowMissingColumns=True).select("block", "id", "text", "r", "ord", "p", "totals", "dev")

    def gather(t: pa.Table) -> pa.RecordBatch | None:
        own, told = _split(t)
        if not own.num_rows:
            return None
        b = Block(own)
        total, dev = _answered(told, "totals"), _answered(told, "dev")
        k, p1, p2 = _estimates(b, total[0] - dev[0], total[1] - dev[1], n - n_d)
        cell = [np.where(p > 0, np.rint(-STEPS * np.log2(np.maximum(p, 2.0**-60))).astype(np.int64), 60 * STEPS) for p in (p1, p2)]
        code = (k << 32) | (cell[0] << 16) | cell[1]
        found, at = np.unique(code, return_inverse=True)
        cols = [found, np.bincount(at), np.bincount(at, p1), np.bincount(at, p2)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(d)) for c, d in zip(cols, (np.int64, np.int64, float, float), strict=True)], ["code", "tokens", "p1", "p2"])

    dev_docs = docs.where(F.col("r") == DEV)
    cells = grouped(met(dev_docs, rows.where("block < 0")), ["block"], "code bigint, tokens bigint, p1 double, p2 double", gather, tasks)
    found = cells.groupBy("code").agg(F.sum("tokens").alias("n"), F.sum("p1").alias("p1"), F.sum("p2").alias("p2")).toPandas()
    table_ = np.stack([found.code.to_numpy() >> 32, found.n, found.p1 / found.n, found.p2 / found.n], 1).astype(float) if len(found) else np.zeros((0, 4))
    weights = learn_weights(table_[np.lexsort((table_[:, 3], table_[:, 2], table_[:, 0]))], 1 / (v_rest + 1))

    def score(t: pa.Table) -> pa.RecordBatch | None:
        own, told = _split(t)
        if not own.num_rows:
            return None
        b = Block(own)
        uni, bi = _answered(told, "totals")
        k, p1, p2 = _estimates(b, uni, bi, n)
        w = weights[k]
        if n:
            model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1))
        else:
            model = np.zeros(len(k))
        c = uni[b.w]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        by = lambda x: np.bincount(b.doc, x, b.n_docs)
        r = np.asarray(own.column("r").to_numpy())
        cols = [own.column("id").combine_chunks(), pa.array(r == TEST), pa.array(b.length.astype(np.int64)), pa.array(by((c > 0).astype(float)).astype(np.int64)), pa.array(np.full(b.n_docs, n, np.int64)), pa.array(by(base)), pa.array(by(model))]
        return pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    more = T._parse_datatype_string("held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    out = grouped(met(docs, rows), ["block"], T.StructType([T.StructField("id", kind), *more.fields]), score, tasks)
    return out.withColumnRenamed("id", key)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op8_lm_score": op8_lm_score}, {}
