"""Benchmark decontamination with suffix arrays over the training texts.

Each shard (a slice of a partition, bounded in bytes) gets a suffix array over its words, sorted by prefix
doubling as deep as the longest benchmark item; only groups that are still tied are sorted again. Every
benchmark suffix is binary-searched in it, all at once, which gives the range of suffixes that begin with its
first ``window`` words and so every occurrence; occurrences that follow one another in both texts are joined
to the longest verbatim matches. Documents are read once, nothing is shuffled. A benchmark beyond a bounded size
reaches the executors in blocks, with one pass for each block over rows that are written once with a number of
their own, by which the blocks' results are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm.common import arrow_map, fresh, materialise, table
from emberflow.llm.textkit import U, mix, slices, text_buffer, words

WINDOW = 10
#: UTF-8 bytes of text in a shard, and of benchmark text in a block (its expanded windows are some 16 times that);
#: a larger benchmark is searched in several passes.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 4 << 20


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes of ``tokens`` (uint32), sorted by their first ``depth`` tokens at least."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64)
    key = tokens.astype(U) << U(32)
    key[:-1] |= tokens[1:].astype(U)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = start + 1
    rank[n] = 0
    done = 2
    tied = ~new
    tied[:-1] |= ~new[1:]
    places = np.flatnonzero(tied)
    while done < depth and len(places):
        who = order[places]
        key = (rank[who].astype(U) << U(32)) | rank[np.minimum(who + done, n)].astype(U)
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[places] = who
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[who] = np.maximum.accumulate(np.where(new, places, 0)) + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = places[tied]
        done *= 2
    return order


def equal_range(tokens: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``wanted`` the range of ``order`` whose suffixes begin with that row. ``tokens`` must
    be followed by as many entries as a row has."""
    m, w = wanted.shape
    cols = np.arange(w)
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(m, np.int64), np.full(m, len(order), np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) >> 1
            have, want = tokens[order[mid][:, None] + cols], wanted[live]
            differ = have != want
            at = differ.argmax(1)
            some = differ[np.arange(len(live)), at]
            less = have[np.arange(len(live)), at] < want[np.arange(len(live)), at]
            right = np.where(some, less, upper)
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


def windows(items: list[tuple[str, str | None]], window: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """By width: the distinct windows' word values, and for each (item, its word) the number of its window; the longest item's words."""
    by: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    longest = 0
    data, off = text_buffer(pa.array([t for _, t in items], pa.string()))
    value, _, owner = words(data, off, "alnum")
    ends = np.searchsorted(owner, np.arange(len(items) + 1))
    for i in range(len(items)):
        v = value[ends[i] : ends[i + 1]]
        if len(v) == 0:
            continue
        longest = max(longest, len(v))
        w = min(window, len(v))
        rows = np.lib.stride_tricks.sliding_window_view(v, w)
        by.setdefault(w, []).append((rows, np.full(len(rows), i), np.arange(len(rows))))
    out = {}
    for w, parts in by.items():
        rows = np.concatenate([p[0] for p in parts])
        distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        by_window = np.argsort(inverse, kind="stable")
        owners = np.stack([np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])], 1)[by_window]
        out[w] = (distinct, owners, np.searchsorted(inverse[by_window], np.arange(len(distinct) + 1)))
    return out, longest


def search(data: np.ndarray, off: np.ndarray, wanted: dict, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the maximal matches as rows (text, item, word in text, word in item, words)."""
    n_docs = len(off) - 1
    value, _, doc = words(data, off, "alnum")
    n_words = np.bincount(doc, minlength=n_docs)
    width = max(wanted, default=1)
    # one separator behind each text, no word of any benchmark item but by chance, which the full values rule out
    at = np.arange(len(value)) + doc
    full = mix(np.arange(len(value) + n_docs + width).astype(U) + U(0x5DEECE66D))
    full[at] = value
    ordinal = np.full(len(full), -1, np.int64)
    ordinal[at] = doc
    start = np.concatenate([[0], np.cumsum(n_words + 1)[:-1]]) if n_docs else np.zeros(0, np.int64)
    short = (full >> U(32)).astype(np.uint32)
    order = suffix_array(short[: len(value) + n_docs], max(longest, width))
    found = []
    for w, (rows, owners, bounds) in wanted.items():
        lo, hi = equal_range(short, order, (rows >> U(32)).astype(np.uint32))
        some = np.flatnonzero(hi > lo)
        n = (hi - lo)[some]
        which = np.repeat(some, n)
        place = order[np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        true = (full[place[:, None] + np.arange(w)] == rows[which]).all(1)
        which, place = which[true], place[true]
        k = bounds[which + 1] - bounds[which]
        own = owners[np.repeat(bounds[which], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        place = np.repeat(place, k)
        d = ordinal[place]
        found.append(np.stack([d, own[:, 0], place - start[d], own[:, 1], np.full(len(d), w)], 1))
    hits = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
    if not len(hits):
        return n_words, hits
    hits = hits[np.lexsort((hits[:, 2], hits[:, 2] - hits[:, 3], hits[:, 1], hits[:, 0]))]
    a, b = hits[:-1], hits[1:]
    new = np.concatenate([[True], (a[:, :2] != b[:, :2]).any(1) | (a[:, 2] + 1 != b[:, 2]) | (a[:, 3] + 1 != b[:, 3])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(hits)]]) - 1
    out = hits[first]
    out[:, 4] += last - first
    return n_words, out


MATCHES = "array<struct<item_id: string, doc_word: bigint, item_word: bigint, n_words: bigint>>"


RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches")


def _covered(spans: list[tuple[int, int]]) -> int:
    n, end = 0, 0
    for s, e in sorted(spans):
        n += max(0, e - max(s, end))
        end = max(end, e)
    return n


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items, by blocks that the driver and each worker can hold."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield [(r.i, r.t) for r in rows]


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row's ``carry`` columns (default doc_id) and its n_words, n_hit, n_items, items_sha256, contaminated, and matches:
    the longest verbatim matches of ``window`` words or more as (item_id, doc_word, item_word, n_words).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. An
    item of fewer words than ``window``, but not none, is matched whole. A document word inside any match is
    hit. Null and empty texts have no words and no matches; an item without words is never found, and items
    that repeat an identifier count once. A null item identifier is listed as an empty string. An empty
    benchmark hits nothing. Rows that repeat an identifier or have none stay rows of their own.
    Whole texts are searched, whatever their length; an empty table stays empty. Carried columns named like a result
    column are left out.
    """
    carry = [c for c in carry or ["doc_id"] if c.lower() not in RESULT]
    spark = df.sparkSession
    body, row = fresh(carry, "body", "row")
    quoted = [F.col(f"`{c}`") for c in carry]
    if text in carry:  # the text goes to the workers once
        body, narrow = text, df.select(*quoted)
    else:
        narrow = df.select(*quoted, F.col(text).alias(body))
    more = T._parse_datatype_string(f"n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, matches {MATCHES}")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))]

    def scan(rows: DataFrame, items: list[tuple[str, str | None]]) -> DataFrame:
        own_columns = [c for c in rows.columns if c in carry or c == row]
        schema = T.StructType([*(rows.schema[c] for c in own_columns), *more.fields])
        found, longest = windows(items, window)
        sent = spark.sparkContext.broadcast((found, longest, [i for i, _ in items]))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, deep, names = sent.value
            for batch in batches:
                for b in slices(batch, body, SHARD_BYTES):
                    n_words, hits = search(*text_buffer(b.column(body)), wanted, deep)
                    m = b.num_rows
                    n_hit, n_items, sha, lists = [0] * m, [0] * m, [_sha([])] * m, [[]] * m
                    at = np.searchsorted(hits[:, 0], np.arange(m + 1)) if len(hits) else None
                    for i in np.unique(hits[:, 0]).tolist():
                        own = hits[at[i] : at[i + 1]].tolist()
                        n_hit[i] = _covered([(h[2], h[2] + h[4]) for h in own])
                        ids = sorted({names[h[1]] for h in own})
                        n_items[i], sha[i] = len(ids), _sha(ids)
                        lists[i] = [{"item_id": names[h[1]], "doc_word": h[2], "item_word": h[3], "n_words": h[4]} for h in own]
                    new = [n_words, n_hit, n_items, sha, [h > 0 for h in n_hit], lists]
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own_columns), *(pa.array(x, k) for x, k in zip(new, kinds, strict=True))], [*own_columns, *(f.name for f in more.fields)])

        return arrow_map(rows, work, schema)

    blocks = _blocks(benchmark, item, item_text, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return scan(narrow, first)
    rows = materialise(narrow.withColumn(row, F.monotonically_increasing_id()), "benchmark-rows")
    out = scan(rows, first).unionByName(scan(rows, second))
    for items in blocks:
        out = out.unionByName(scan(rows, items))
    return _merge(out, row, carry, more)


def _sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def _merge(found: DataFrame, row: str, carry: list[str], more: T.StructType) -> DataFrame:
    """All blocks' results in one, by the number of the row."""
    names = [f.name for f in more.fields]
    both = found.groupBy(row).agg(*(F.first(F.col(f"`{c}`")).alias(c) for c in [*carry, "n_words"]), F.flatten(F.collect_list("matches")).alias("matches"))
    pos = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["doc_word"], m["doc_word"] + m["n_words"] - 1))))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    out = both.withColumns({"n_hit": F.size(pos).cast("bigint"), "n_items": F.size(ids).cast("bigint"), "items_sha256": F.sha2(F.concat_ws(",", ids), 256)})
    return out.withColumn("contaminated", F.col("n_hit") > 0).select(*(F.col(f"`{c}`") for c in carry), *names)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') as s
       from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
dw as (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as s
       from d, (select distinct n from bw) x, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
hit as (select distinct doc_id, i, n, item_id from dw join bw using (n, s)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
        from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""
QUERIES, SQL = {"op7_decontaminate": op7_decontaminate}, {"op7_decontaminate": ORACLE}
