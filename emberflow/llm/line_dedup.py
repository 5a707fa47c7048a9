"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A document is its sequence of non-blank lines. For each line, the guarantee window is the shortest run of
lines from it on that holds ``min_words`` words; the window's fingerprint is the line with the smallest hash in
it, the last one of equals. Neighbouring windows mostly have the same fingerprint, so the selected lines are a
fraction of all; two documents that share a window select the same line in it. Selected lines are joined by their
hash with their positions. Around those whose hash stands more than once, matches are extended: to the left
through the windows that begin further up and have the same fingerprint, to the right line by line up to the end
of the next window (which is a match with a fingerprint of its own if all lines agree). Every extent is compared
as a whole, by 128 bits over the lines in it. Each extent has its earliest occurrence, so an occurrence extends to
the longest run that any earlier occurrence holds, and no pairs are made. All but the earliest occurrence of a
repeated run are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberflow.llm.common import discard, fresh, materialise, meet, table


def _both(*cols: Column | str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)


def fingerprints(df: DataFrame, text: str, key: str, min_words: int) -> DataFrame:
    """(k, id, f, at, windows): the selected lines of each document, by hash and 0-based line, with the windows they are selected in.

    ``k`` is xxhash64(key, text). A window is (pos, end, d, e, rest): its first and last line, its digest, and the lines that
    follow it up to the end of the next window.
    """
    base = df.select(F.xxhash64(key, text).alias("k"), F.col(key).alias("id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    h, g = _both(F.trim("line"))
    lines = base.select("k", "id", "pos", h.alias("h"), g.alias("g"), words.alias("w")).where("w > 0")
    # rows that repeat a key and a text are one document: its lines count once
    lines = lines.repartition("k", "id").withColumn("copy", F.row_number().over(Window.partitionBy("k", "id", "pos").orderBy("h"))).where("copy = 1").drop("copy")
    by_pos = Window.partitionBy("k", "id").orderBy("pos")
    placed = lines.withColumn("s", F.sum("w").over(by_pos) - F.col("w"))
    ahead = Window.partitionBy("k", "id").orderBy("s").rangeBetween(0, min_words - 1)
    line = F.struct("h", "g", "pos")
    framed = placed.select("k", "id", "pos", "s", F.min("h").over(ahead).alias("f"), F.sum("w").over(ahead).alias("n"), F.collect_list(line).over(ahead).alias("run"))
    after = F.lead("run").over(Window.partitionBy("k", "id").orderBy("s"))
    rest = F.when(after.isNull() | (F.size(after) < F.size("run")), F.slice("run", 1, 0)).otherwise(F.slice(after, F.size("run"), F.size(after)))
    full = framed.select("k", "id", "pos", "f", "n", "run", rest.alias("rest")).where(F.col("n") >= min_words)
    at = F.element_at(F.filter("run", lambda x: x["h"] == F.col("f")), -1)["pos"]
    d, e = _both(F.transform("run", lambda x: F.struct(x["h"], x["g"])))
    window = F.struct("pos", F.element_at("run", -1)["pos"].alias("end"), d.alias("d"), e.alias("e"), "rest")
    return full.select("k", "id", "f", at.alias("at"), window.alias("window")).groupBy("k", "id", "f", "at").agg(F.collect_list("window").alias("windows"))


def repeated_runs(df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 50) -> DataFrame:
    """The line ranges to delete, disjoint: (k, id, islands); ``k`` is xxhash64(key, text), islands are sorted (start, end) of 0-based lines."""
    n_rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    prints = materialise(fingerprints(df, text, key, min_words), "line-prints", size)
    shared = materialise(prints.groupBy("f").agg(F.count("*").alias("times")).where("times > 1"), "line-shared", size // 8)
    place = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("k").alias("c"), F.col("pos").alias("d"))
    windows = meet(prints, shared, ["f"]).select("k", "id", F.inline("windows"))
    # digests of the window with its first 0, 1, 2... following lines: each has its own earliest occurrence
    onward = F.aggregate(
        "rest", F.array(F.struct("d", "e")),
        lambda a, x: F.concat(a, F.array(F.struct(*(c.alias(n) for c, n in zip(_both(F.element_at(a, -1)["d"], F.element_at(a, -1)["e"], x["h"], x["g"]), "de", strict=True))))),
    )
    extents = windows.select("k", "id", "pos", "end", place.alias("place"), F.col("rest.pos").alias("ends"), F.posexplode(onward).alias("ext", "both"))
    stop = F.when(F.col("ext") > 0, F.try_element_at("ends", F.col("ext"))).otherwise(F.col("end"))
    extents = materialise(extents.select("k", "id", "pos", stop.alias("end"), "place", "ext", "both.d", "both.e"), "line-extents", size)
    firsts = extents.groupBy("d", "e", "ext").agg(F.count("*").alias("times"), F.min("place").alias("first")).where("times > 1")
    firsts = materialise(firsts, "line-firsts", size // 4)
    later = meet(extents, firsts, ["d", "e", "ext"]).where(F.col("place") > F.col("first"))
    spans = later.groupBy("k", "id", "pos").agg(F.max("end").alias("end"))
    before = Window.partitionBy("k", "id").orderBy("pos", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(F.col("pos") <= reach + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("k", "id", "island").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    found = materialise(merged.groupBy("k", "id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("islands")), "line-islands", 128 * n_rows)
    discard(prints, shared, extents, firsts)
    return found


def line_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 50) -> DataFrame:
    """``df`` with the later occurrences of repeated runs deleted from ``text``, and the columns n_lines and n_deleted.

    A run is consecutive non-blank lines, equal but for spaces at their ends, of ``min_words`` words or more
    in all (a single line may be enough). An occurrence is later than another if its ``key`` is larger, null
    keys being largest, or if it stands further down in the same document. Rows that repeat a key and a text
    are one document: each is treated alike. Blank lines inside a deleted run go with it. Null texts stay
    null, with no lines; a text of which all goes becomes empty. Names of other columns may be anything but
    n_lines and n_deleted, which are replaced. An empty table stays empty.
    """
    names = [c for c in df.columns if c.lower() not in ("n_lines", "n_deleted")]
    k, own, gone, lines, i = fresh(df.columns, "k", "own", "gone", "lines", "i")
    found = repeated_runs(df, text, key, min_words).select(F.col("k").alias(k), F.col("id").alias(own), F.col("islands").alias(gone))
    docs = df.select(*names).withColumn(k, F.xxhash64(key, text))
    # the runs grow with the documents, so they meet by a shuffle at every size, never by a broadcast that an estimate allows
    joined = docs.join(found.withColumnRenamed(k, i).hint("merge"), (docs[k] == F.col(i)) & docs[key].eqNullSafe(F.col(own)), "left")
    cut = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(F.col(text), "\n", -1)))
    total = F.size(lines)

    def part(t):
        start = F.when(t == 0, F.lit(0)).otherwise(F.try_element_at(gone, F.greatest(t, F.lit(1)))["end"] + 1)
        stop = F.when(t == F.size(gone), total).otherwise(F.get(gone, t)["start"])
        return F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0)))

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), part)), "\n")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1).cast("bigint")
    deleted = F.coalesce(F.aggregate(gone, F.lit(0), lambda a, x: a + x["end"] - x["start"] + 1), F.lit(0)).cast("bigint")
    return cut.select(*(F.when(F.col(gone).isNotNull(), kept).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in names), n_lines.alias("n_lines"), deleted.alias("n_deleted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", "text")


def oracle(min_words: int = 50) -> str:
    return rf"""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line from documents),
n as (select doc_id, pos, trim(line) as h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from l),
p as (select *, sum(w) over (partition by doc_id order by pos) - w as s, row_number() over (partition by doc_id order by pos) as o from n where w > 0),
a as (select doc_id, list(h order by pos) as h from p group by doc_id),
g as (select doc_id, pos, o, s, max(o) over ahead as last, sum(w) over ahead as m from p
      window ahead as (partition by doc_id order by s range between current row and {min_words - 1} following)),
u as (select *, lead(last) over (partition by doc_id order by o) as reach from g),
f as (select * from u where m >= {min_words}),
x as (select f.doc_id, f.pos, f.o, t.e, list_slice(a.h, f.o, t.e) as run
      from f join a using (doc_id), lateral (select unnest(range(f.last, greatest(coalesce(f.reach, f.last), f.last) + 1)) as e) t),
d as (select *, first_value(doc_id) over q as d0, first_value(o) over q as o0 from x window q as (partition by run order by doc_id, pos)),
e as (select doc_id, o, max(e) as e from d where (doc_id, o) <> (d0, o0) group by doc_id, o),
r as (select e.doc_id, a.pos as start, b.pos as stop from e join p a on a.doc_id = e.doc_id and a.o = e.o join p b on b.doc_id = e.doc_id and b.o = e.e),
z as (select distinct doc_id, unnest(range(start, stop + 1)) as pos from r),
k as (select l.doc_id, count(*) as n_lines, count(z.pos) as n_deleted, coalesce(string_agg(case when z.pos is null then line end, chr(10) order by l.pos), '') as text
      from l left join z on z.doc_id = l.doc_id and z.pos = l.pos group by l.doc_id)
select documents.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted, k.text as text from documents left join k using (doc_id)
"""


QUERIES, SQL = {"op10_line_dedup": op10_line_dedup}, {"op10_line_dedup": oracle()}
