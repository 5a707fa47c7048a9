"""Similarity self-join on word shingles by chosen paths.

Texts are sets of five-word shingles, embedded as ``T_COORDS`` min-hash tokens. In each run a set walks down
from the root and takes every token that a hash of (run, path, token) samples, 1/threshold of them on
average a level, so that similar sets choose the same paths; the paths after ``depth`` levels are buckets,
and two sets of similarity s share one with the probability that a branching process of mean s/threshold
survives. Depth grows with the logarithm of the input, and the number of runs follows from the depth
and the target recall. A bucket beyond the block size is split on further sampled tokens, in runs of its own, and so are
its parts, as long as the parts have at most half of the bucket's pairs together; where they have more, its sets
are too alike to be told apart by paths, and it is compared in blocks. Small buckets are compared by brute force on the
true sets. Of buckets with the same members one is compared.

Sets that are equal are one class from the start, so copies cost nothing here. Buckets give spanning edges,
never all pairs. Components of these edges are then compared once more, all members against all in blocks of
a bounded size, which counts every class's links exactly whatever path found it. The second round of runs
skips buckets that lie in one component already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm.common import arrow_map, discard, grouped, materialise, meet, table
from emberflow.llm.textkit import U, chain, mix, slices, text_buffer, words

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9999
T_COORDS = 64
#: Runs of the first round.
FIRST_RUNS = 4
#: Shingles and sets of a block; two blocks are compared in one worker.
BLOCK_SHINGLES, BLOCK_SETS = 500_000, 500
#: Bytes of a shingle in an exchange: among 10,000 shingles of either text two differ in none of these bits by chance once in 10^6 pairs.
PACKED = 6
#: Runs of a further split of a bucket, and the share of its pairs that all its parts may have together for the split to be worth it.
SPLIT_RUNS, SPLIT_SHARE = 4, 0.5
_A = mix(np.arange(1, T_COORDS + 1).astype(U)) | U(1)
_C = mix(np.arange(1, T_COORDS + 1).astype(U) + U(1 << 32))


def survival(depth: int, mean: float = 1.0) -> float:
    """The chance that a branching process with T_COORDS trials a node and this mean lives for ``depth`` levels."""
    q = 0.0
    for _ in range(depth):
        q = (1 - mean / T_COORDS * (1 - q)) ** T_COORDS
    return 1 - q


def plan(n: int, recall: float = RECALL) -> tuple[int, int]:
    """(depth, runs) for ``n`` sets."""
    depth = max(3, round(math.log2(max(n, 2)) / 6))
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words, but not none, is one shingle."""
    value, _, doc = words(data, off, "alnum")
    n = len(off) - 1
    ends = np.searchsorted(doc, np.arange(n + 1))
    all_grams = chain(value, width)
    out = []
    for i in range(n):
        a, b = ends[i], ends[i + 1]
        if b - a >= width:
            s = np.sort(all_grams[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(chain(value[a:b], int(b - a)) if b > a else np.zeros(0, U))
    return out


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two signed columns; (0, 0) for the empty set."""
    d1, d2 = np.zeros(len(sets), U), np.zeros(len(sets), U)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        d1[full] = mix(np.add.reduceat(mix(x), at))
        d2[full] = mix(np.add.reduceat(mix(x ^ U(0xA5A5A5A5A5A5A5A5)), at))
    return d1.view(np.int64), d2.view(np.int64)


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """The T_COORDS min-hash tokens of each of some sets that aren't empty."""
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), T_COORDS), U)
    for c in range(T_COORDS):
        out[:, c] = mix(np.minimum.reduceat((x ^ _C[c]) * _A[c], at)) + U(c)
    return out


def descend(token: np.ndarray, owner: np.ndarray, path: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(owner, path) of the paths one level down: each of ``path`` goes on by every token of its owner that is sampled there."""
    limit = U(min(int((1 << 64) / (threshold * T_COORDS)), (1 << 64) - 1))
    tried = mix(token[owner] ^ path[:, None])
    node, coord = np.nonzero(tried < limit)
    return owner[node], mix(tried[node, coord] * U(0x9E3779B97F4A7C15) + path[node])


def paths(sets: list[np.ndarray], threshold: float, depth: int, runs: range) -> list[list[int]]:
    """The buckets that each set reaches in these runs."""
    out: list[list[int]] = [[] for _ in sets]
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full) or not len(runs):
        return out
    token = tokens([sets[i] for i in full])
    for run in runs:
        owner, path = np.arange(len(full)), np.full(len(full), mix(np.array([run + 1], U))[0], U)
        for _ in range(depth):
            owner, path = descend(token, owner, path, threshold)
        for i, p in zip(full[owner].tolist(), path.view(np.int64).tolist(), strict=True):
            out[i].append(p)
    return [sorted(set(p)) for p in out]


def children(token: np.ndarray, leaves: np.ndarray, threshold: float, runs: int = SPLIT_RUNS) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, bucket) of the buckets that each set, given by its tokens, reaches when its bucket of ``leaves`` is split in ``runs`` runs."""
    found = [descend(token, np.arange(len(token)), mix(leaves.view(U) ^ mix(np.full(1, r + 1, U))), threshold) for r in range(runs)]
    both = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1].view(np.int64) for f in found])], 1), axis=0)
    return both[:, 0], both[:, 1]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of all pairs: frequent shingles by matrix products over bounded groups of columns,
    rare ones by their pairs of postings, in bounded groups too."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    x = np.concatenate(sets) if m else np.zeros(0, U)
    by = np.argsort(x, kind="stable")
    x, who = x[by], who[by]
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    df = np.diff(np.concatenate([start, [len(x)]]))
    rare = int(0.08 * m)  # where a product costs more than the pairs of postings
    upper = np.zeros(m * m, np.int32)
    held, n = [], 0
    for k in np.unique(df[(df > 1) & (df <= rare)]).tolist():
        left, right = np.triu_indices(k, 1)
        some = start[df == k]
        step = max(1, (1 << 20) // len(left))
        for c in range(0, len(some), step):
            own = who[some[c : c + step, None] + np.arange(k)]
            held.append((own[:, left] * m + own[:, right]).ravel())
            n += len(held[-1])
            if n > 2 * m * m:
                upper += np.bincount(np.concatenate(held), minlength=m * m).astype(np.int32)
                held, n = [], 0
    if held:
        upper += np.bincount(np.concatenate(held), minlength=m * m).astype(np.int32)
    out = upper.reshape(m, m)
    out = out + out.T
    many = np.flatnonzero(df > max(rare, 1))
    step = max(256, (4 << 20) // max(m, 1))
    for c in range(0, len(many), step):
        some = many[c : c + step]
        n_of = df[some]
        rows = who[np.repeat(start[some] - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())]
        dense = np.zeros((m, len(some)), np.float32)
        dense[rows, np.repeat(np.arange(len(some)), n_of)] = 1
        out += (dense @ dense.T).astype(np.int32)
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of ``threshold`` or more (never with itself)."""
    size = np.array([len(s) for s in sets], np.int32)
    shared = overlaps(sets)
    union = size[:, None] + size[None, :] - shared
    out = (shared >= threshold * union - 1e-9) & (shared > 0)
    np.fill_diagonal(out, False)
    return out


def roots(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index that each index is connected with."""
    m = len(adjacent)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], m).min(1, initial=m))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _packed(sets: list[np.ndarray]) -> pa.Array:
    """Sets in PACKED bytes a shingle, by which shingles are told apart when sets are compared."""
    small = (np.unique(s & U((1 << 8 * PACKED) - 1)) for s in sets)
    return pa.array([np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :PACKED]).tobytes() for s in small], pa.binary())


def _sets_of(t: pa.Table) -> list[np.ndarray]:
    """The sets that ``_packed`` made, from the column ``grams``."""
    out = []
    for x in t.column("grams").to_pylist():
        wide = np.zeros((len(x) // PACKED, 8), np.uint8)
        wide[:, :PACKED] = np.frombuffer(x, np.uint8).reshape(-1, PACKED)
        out.append(wide.view("<u8").ravel())
    return out


def components(edges: DataFrame, n_bytes: int | None = None) -> DataFrame:
    """(node, label): the smallest node that each node of the undirected ``edges`` (a, b) is connected with.

    Smallest labels spread along the edges, and each label jumps to its own label's label; a round's result
    is written to the shared folder.
    """
    both = materialise(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"), "join-edges", n_bytes)
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "join-labels", n_bytes)
    while True:
        near = both.join(labels.toDF("b", "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        new = materialise(new, "join-labels", n_bytes)
        jumped = new.join(new.select(F.col("node").alias("new"), F.col("new").alias("top")), "new", "left").select("node", F.least("new", F.coalesce("top", "new")).alias("label"), "old")
        jumped = materialise(jumped, "join-labels", n_bytes)
        discard(labels, new)
        labels, written = jumped.select("node", "label"), jumped
        labels._written_to = written._written_to
        if jumped.where("label <> old").limit(1).count() == 0:
            discard(both)
            return labels


def ngram_join(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL) -> DataFrame:
    """(``key``, class_id, n_links, class_size), a row for each input row: the smallest identifier of its connected component,
    the number of other rows whose shingle sets have a Jaccard similarity of ``threshold`` or more with its own, and the
    component's rows.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A text
    of fewer than ``width`` words is one shingle of them all. Null, empty and wordless texts have no shingle
    and link with nothing: each is its own class. Equal sets are links. Null identifiers are allowed; the
    class is null if all of it are. Rows that repeat an identifier and a text are rows of their own and links of each
    other. A pair of exactly ``threshold`` is a link. Whole texts count, whatever their length. Other columns are ignored.
    An empty table gives no rows.
    """
    narrow = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = narrow.schema["id"].dataType
    n_rows, size = narrow.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    few = 128 * n_rows  # bytes of a table of identifiers
    depth, runs = plan(n_rows, recall)
    first = range(min(FIRST_RUNS, runs))
    later = range(len(first), runs)
    wide = few + 16 * n_rows * runs * math.ceil((1 / threshold) ** depth)  # and of one of paths

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = shingle_sets(*text_buffer(b.column("text")), width)
                d1, d2 = digests(sets)
                lists = [pa.array(paths(sets, threshold, depth, r), pa.list_(pa.int64())) for r in (first, later)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(d1), pa.array(d2), pa.array([len(s) for s in sets], pa.int64()), *lists], ["id", "d1", "d2", "n", "l1", "l2"])

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("id", kind), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("n", T.LongType())]
    rows = materialise(arrow_map(narrow, embed, T.StructType([*fields, T.StructField("l1", longs), T.StructField("l2", longs)])), "join-rows", size)
    # a class is a set; its first digest names it, and the second tells apart what the first would confuse
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("l1").alias("l1"), F.first("l2").alias("l2"))
    classes = materialise(classes, "join-classes", wide)
    node = F.unhex(F.concat(*(F.lpad(F.hex(d), 16, "0") for d in ("d1", "d2"))))  # 16 bytes
    nodes = classes.select(node.alias("node"), "rep", "size", "n", "l1", "l2")
    leaves = nodes.select("node", "n", F.explode("l1").alias("leaf"), F.lit(0).alias("round")).unionByName(nodes.select("node", "n", F.explode("l2").alias("leaf"), F.lit(1).alias("round")))
    shared = materialise(_buckets(leaves, "leaf", "round"), "join-leaves", wide)
    placed = meet(leaves.drop("round"), shared, ["leaf"], "members").select("node", "n", "leaf", "members", "total", "round")
    placed = materialise(placed, "join-placed", wide)
    wanted = materialise(placed.select("node").distinct(), "join-wanted", few)
    reps = nodes.join(wanted, "node").select(F.col("rep"), F.col("node").alias("want"))
    texts = narrow.join(reps, narrow.id.eqNullSafe(reps.rep)).select("text", "want")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = shingle_sets(*text_buffer(b.column("text")), width)
                d1, d2 = digests(sets)
                own = pa.array([x.tobytes() for x in np.stack([d1, d2], 1).byteswap()], pa.binary())
                yield pa.RecordBatch.from_arrays([own, b.column("want"), _packed(sets)], ["node", "want", "grams"])

    sets = arrow_map(texts, grams, "node binary, want binary, grams binary").where("node = want").dropDuplicates(["node"]).select("node", "grams")
    sets = materialise(sets, "join-sets", 2 * size)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = tokens(_sets_of(pa.Table.from_batches([b]))) if b.num_rows else np.zeros((0, T_COORDS), U)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([t.view(np.int64) for t in own], longs_)], ["node", "token"])

    longs_ = pa.list_(pa.int64())
    sketches: list[DataFrame] = []  # written when a bucket is first split

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "node", 1 << 15):  # 2,048 sets
                token = np.asarray(b.column("token").flatten()).view(U).reshape(-1, T_COORDS)
                at, child = children(token, np.asarray(b.column("leaf")), threshold)
                own = b.select(["node", "n", "leaf"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(child)], ["node", "n", "parent", "leaf"])

    def small_buckets(own: DataFrame) -> DataFrame:
        """The members of buckets, each split as long as that pays; ``own`` is a written table of (node, n, leaf, members, total)."""
        over = (F.col("members") > BLOCK_SETS) | (F.col("total") > BLOCK_SHINGLES)
        done, now = [], own
        while now.where(over).limit(1).count():
            done.append(now.where(~over))
            big = now.where(over)
            if not sketches:
                sketches.append(materialise(arrow_map(sets, sketch, "node binary, token array<bigint>"), "join-sketch", few + 8 * T_COORDS * n_rows))
            told = big.join(sketches[0], "node").select("node", "n", "leaf", "token")
            parts = arrow_map(told, split, "node binary, n bigint, parent bigint, leaf bigint")
            parts = materialise(parts, "join-parts", wide)
            found = materialise(_buckets(parts, "leaf", "parent"), "join-part-leaves", wide)
            work = found.groupBy("parent").agg(F.sum(F.pow("members", F.lit(2))).alias("work"))
            parents = big.groupBy("leaf").agg(F.first("members").alias("members"))
            pays = parents.join(work.withColumnRenamed("parent", "leaf"), "leaf", "left").where(F.coalesce("work", F.lit(0.0)) <= SPLIT_SHARE * F.pow("members", F.lit(2)))
            pays = materialise(pays.select("leaf", "members"), "join-splits", few)
            halved = meet(big.drop("members"), pays, ["leaf"], "members").select("node", "leaf")
            done.append(big.join(halved.select("node", "leaf"), ["node", "leaf"], "left_anti"))  # too alike for a split
            kept = found.join(pays.select(F.col("leaf").alias("parent")), "parent", "left_semi").drop("parent")
            now = materialise(meet(parts.drop("parent"), kept, ["leaf"], "members").select(*own.columns), "join-split", wide)
        done.append(now)
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out

    def spanning(t: pa.Table) -> pa.RecordBatch | None:
        # a member of both blocks' pair stands once; members of one component need no edge
        names = t.column("node").to_pylist()
        if len(names) < 2:
            return None
        root = roots(linked(_sets_of(t), threshold))
        edges = [(names[i], names[r]) for i, r in enumerate(root.tolist()) if r != i]
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], ["a", "b"]) if edges else None

    def edges_of(round_: int, comp: DataFrame | None) -> DataFrame:
        own = placed.where(F.col("round") == round_).drop("round")
        if comp is not None:
            own = materialise(own.join(comp.withColumnRenamed("label", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "join-round", wide)
            closed = own.groupBy("leaf").agg((F.min("comp") < F.max("comp")).alias("open"), F.count("*").alias("times")).where("open").select("leaf", "times")
            own = meet(own.drop("comp"), materialise(closed, "join-open", wide), ["leaf"])
            own = materialise(own.select("node", "n", "leaf", "members", "total"), "join-members", wide)
        paired = _pairs_of_blocks(small_buckets(own).select("leaf", "node", "members", "total"))
        return grouped(paired.join(sets, "node").select("leaf", "i", "j", "node", "grams"), ["leaf", "i", "j"], "a binary, b binary", spanning)

    found = materialise(edges_of(0, None), "join-found", few)
    if len(later):
        comp = components(found, few)
        found = materialise(found.union(edges_of(1, comp)), "join-found", few)
        discard(comp)
    comp = components(found, few)
    members = materialise(comp.join(nodes.select("node", "n", "size"), "node"), "join-in-class", few)
    stats = materialise(members.groupBy("label").agg(F.count("*").alias("members"), F.sum("n").alias("total")), "join-stats", few)
    inside = meet(members, stats, ["label"], "members").select(F.xxhash64("label").alias("leaf"), "label", "node", "size", "members", "total")

    def count(t: pa.Table) -> pa.RecordBatch | None:
        pair = (t.column("i")[0].as_py(), t.column("j")[0].as_py())
        weight = np.asarray(t.column("size").to_numpy(), np.int64)
        block = np.asarray(t.column("block").to_numpy())
        adjacent = linked(_sets_of(t), threshold)
        if pair[0] != pair[1]:  # pairs inside a block are counted where it meets itself
            adjacent &= block[:, None] != block[None, :]
        links = adjacent @ weight
        return pa.RecordBatch.from_arrays([t.column("node").combine_chunks(), pa.array(links.astype(np.int64))], ["node", "links"])

    paired = _pairs_of_blocks(inside).join(sets, "node").select("label", "i", "j", "node", "block", "size", "grams")
    links = grouped(paired, ["label", "i", "j"], "node binary, links bigint", count).groupBy("node").agg(F.sum("links").alias("links"))
    named = members.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("size").alias("rows"), F.count("*").alias("times"))
    named = materialise(named, "join-names", few)
    big = meet(comp, named, ["label"]).join(links, "node", "left").select("node", "class_id", "rows", F.coalesce("links", F.lit(0)).alias("links"))
    all_classes = nodes.join(big, "node", "left").select("node", "rep", "size", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("rows", "size").alias("rows"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    all_classes = materialise(all_classes, "join-named", few)
    discard(classes, shared, placed, wanted, sets, *sketches, found, comp, members, stats, named)
    keyed = rows.select("id", F.when(F.col("n") > 0, node).alias("node"))
    out = keyed.join(all_classes, "node", "left")
    return out.select(F.col("id").alias(key), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("rows", F.lit(1)).cast("bigint").alias("class_size"))


def _buckets(members: DataFrame, leaf: str, order: str) -> DataFrame:
    """(leaf, order, members, total) of the buckets of two members or more; of those with the same members one, the first by ``order``."""
    every = members.groupBy(leaf).agg(F.min(order).alias(order), F.count("*").alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("who"))
    one = every.where("members > 1").groupBy("members", "total", "who").agg(F.min(F.struct(order, leaf)).alias("one"))
    return one.select(f"one.{leaf}", f"one.{order}", "members", "total")


def _pairs_of_blocks(df: DataFrame) -> DataFrame:
    """Members dealt to blocks of a bounded size by a hash, each block's rows sent to every pair of blocks (i <= j) that it is in."""
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_SETS)).cast("int")
    dealt = df.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op3_ngram_join": op3_ngram_join}, {}
