"""Language identification by Bayesian evidence fusion.

The evidence of a text is its likelihood under letter trigrams (hashed to 2**16 cells) of each language, and
of a flat class ``und`` for everything unknown. It is fused with the language that the markup declares and
with a prior of the host. Host priors are hierarchically smoothed: a host's expected counts are drawn to those
of its address suffix, and these to those of all rows. Counts are one grouped aggregation over all rows,
pre-aggregated in each batch; a row's own share is taken out of its host's counts before they are used for it.

Only the trigram tables are fitted on labelled rows, of which about ``max_rows`` are taken (by a hash of the
identifier); the counts cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm.common import arrow_map, fresh, materialise, table
from emberflow.llm.textkit import LOWER_TABLE, slices, text_buffer

CELLS = 1 << 16
MAX_ROWS = 20_000
#: Weight of a level's own counts against the level above, and the share of declarations that are right.
SMOOTHING, DECLARED_RIGHT = 20.0, 0.9
#: Prior share of ``und``, and the posterior that an accepted language needs.
UNKNOWN_SHARE, ACCEPT = 1e-3, 0.5
#: Hosts are broadcast only up to so many; beyond that rows meet their host in a salted join.
BROADCAST_HOSTS, SALTS = 200_000, 16
UNKNOWN = "und"

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER = _LETTER[LOWER_TABLE]
_FIRST, _SECOND, _THIRD = (np.arange(256, dtype=np.uint32) * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of every letter trigram; all but letters count as a space, and trigrams with two spaces are left out."""
    if len(data) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    b = _LETTER[data]
    code = _FIRST[b[:-2]]
    code += _SECOND[b[1:-1]]
    code += _THIRD[b[2:]]
    code ^= code >> np.uint32(15)
    code &= np.uint32(CELLS - 1)
    space = b == 0x20
    keep = (space[:-2].astype(np.int8) + space[1:-1] + space[2:]) < 2
    for k in (1, 2):  # no trigram over the edge of two texts
        edge = off[1:-1] - k
        keep[edge[(edge >= 0) & (edge < len(keep))]] = False
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int32), [0, 0]])
    kept[-2:] = kept[-3]
    return code[keep].astype(np.int32), np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(kept[off]))


@dataclass(frozen=True)
class LanguageModel:
    """``logp``: CELLS x languages, the last one ``und``."""

    languages: tuple[str, ...]
    logp: np.ndarray

    def likelihoods(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of each text (texts x languages), and the bytes of its letters."""
        cell, text = trigrams(data, off)
        n = len(off) - 1
        count = np.diff(np.concatenate([[0], np.cumsum(_LETTER[data] != 0x20, dtype=np.int32)])[off])
        out = np.stack([np.bincount(text, self.logp[cell, k], n) for k in range(len(self.languages))], 1) if len(cell) else np.zeros((n, len(self.languages)))
        return out, count


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", max_rows: int = MAX_ROWS) -> LanguageModel:
    """Trigram tables from about ``max_rows`` of the rows with a label, all of them if there are fewer."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    n = rows.count()
    part = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_rows / max(n, 1)))
    sample = rows.where(part).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                cell, doc = trigrams(*text_buffer(b.column("text")))
                names, index = np.unique(np.array(b.column("label").to_pylist(), object), return_inverse=True)
                both, times = np.unique(index[doc].astype(np.int64) * CELLS + cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[both // CELLS].tolist(), pa.string()), pa.array(both % CELLS), pa.array(times.astype(np.int64))], ["label", "cell", "n"])

    found = arrow_map(sample, count, "label string, cell bigint, n bigint").groupBy("label", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(found.label)))
    logp = np.full((CELLS, len(languages) + 1), -np.log(CELLS))
    for k, name in enumerate(languages):
        own = found[found.label == name]
        counts = np.full(CELLS, 0.05)
        counts[own.cell.to_numpy()] += own.n.to_numpy()
        logp[:, k] = np.log(counts / counts.sum())
    return LanguageModel((*languages, UNKNOWN), logp)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _flat_prior(n: int) -> np.ndarray:
    return np.log(np.array([(1 - UNKNOWN_SHARE) / max(n - 1, 1)] * (n - 1) + [UNKNOWN_SHARE]))


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased without its port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def identify(df: DataFrame, model: LanguageModel, text: str = "text", host: Column | None = None, declared: Column | None = None) -> DataFrame:
    """``df`` with language, language_confidence and language_accepted.

    ``host`` gives a row's host, ``declared`` what its markup declares (``en`` or ``en-GB``; others and null
    are no evidence). Null and empty texts, and texts without letters, have no language (null), confidence 0,
    and aren't accepted; neither are rows whose best class is ``und`` or has a posterior under ACCEPT. A null
    host is the empty host. Of equally likely languages the first by name is taken. Whole texts are judged,
    whatever their length. A model without languages (nothing was labelled) accepts nothing. Rows keep their
    order of columns; columns named like the new ones are replaced. Repeated rows are judged alike. An empty
    table stays empty.
    """
    new = ("language", "language_confidence", "language_accepted")
    names = [c for c in df.columns if c.lower() not in new]
    body, h, d, own, up = fresh(names, "body", "host", "declared", "own", "up")
    quoted = [F.col(f"`{c}`") for c in names]
    more = [] if text in names else [F.col(text).alias(body)]  # the text goes to the workers once
    body = body if more else text
    read = [*quoted, *(F.col(body) for _ in more)]
    docs = df.select(*quoted, *more, F.coalesce(host if host is not None else F.lit(""), F.lit("")).alias(h), F.lower(F.substring_index(F.coalesce(declared if declared is not None else F.lit(""), F.lit("")), "-", 1)).alias(d))
    n_lang, flat = len(model.languages), _flat_prior(len(model.languages))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, body):
                like, count = sent.value.likelihoods(*text_buffer(b.column(body)))
                p = _softmax(like + flat)[count > 0]
                hosts, at = np.unique(np.array(b.column(h).to_pylist(), object)[count > 0], return_inverse=True)
                if len(hosts):
                    sums = np.stack([np.bincount(at, p[:, k], len(hosts)) for k in range(n_lang)], 1)
                    yield pa.RecordBatch.from_arrays([pa.array(hosts.tolist(), pa.string()), *(pa.array(sums[:, k]) for k in range(n_lang))], ["h", *(f"p{k}" for k in range(n_lang))])

    sums = arrow_map(docs.select(h, f"`{body}`"), shares, "h string, " + ", ".join(f"p{k} double" for k in range(n_lang)))
    by_host = sums.groupBy("h").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(n_lang)))
    by_host = materialise(by_host.select("h", F.array(*(f"p{k}" for k in range(n_lang))).alias("own")), "language-hosts")
    suffix = F.when(F.instr("h", ".") > 0, F.substring_index("h", ".", -1)).otherwise(F.lit(""))
    add = F.array(*(F.sum(F.col("own")[k]) for k in range(n_lang)))
    everything = [float(x or 0) for x in by_host.agg(add.alias("a")).first().a]
    by_suffix = by_host.groupBy(suffix.alias("s")).agg(add.alias("up"))
    n_hosts = by_host.count()
    if n_hosts <= BROADCAST_HOSTS or by_suffix.count() <= BROADCAST_HOSTS:
        by_suffix = F.broadcast(by_suffix)  # one suffix may hold most hosts
    hosts = by_host.withColumn("s", suffix).join(by_suffix, "s").select(F.col("h").alias(f"{h}_h"), F.col("own").alias(own), F.col("up").alias(up))
    if n_hosts <= BROADCAST_HOSTS:
        met = docs.join(F.broadcast(hosts), docs[h] == F.col(f"{h}_h"), "left")
    else:
        (salt,) = fresh([*docs.columns, own, up], "salt")
        spread = hosts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{body}`")), F.lit(SALTS)).cast("int"))
        met = salted.join(spread, (salted[h] == spread[f"{h}_h"]) & (salted[salt] == spread[salt]), "left").drop(salted[salt]).drop(spread[salt])
    met = met.select(*read, d, own, up)
    total = np.array(everything)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.exp(flat)
        for whole in batches:
            for b in slices(whole, body):
                like, count = sent.value.likelihoods(*text_buffer(b.column(body)))
                m = b.num_rows
                p = _softmax(like + flat) * (count > 0)[:, None]
                at_host, at_suffix = (np.array([x or [0.0] * n_lang for x in b.column(c).to_pylist()], float).reshape(m, n_lang) for c in (own, up))
                prior = np.broadcast_to(base, (m, n_lang))
                for level in (np.broadcast_to(total, (m, n_lang)), at_suffix, at_host):
                    rest = np.maximum(level - p, 0)
                    prior = (rest + SMOOTHING * prior) / (rest.sum(1, keepdims=True) + SMOOTHING)
                said = np.zeros((m, n_lang))
                where = {x: k for k, x in enumerate(sent.value.languages[:-1])}
                for i, x in enumerate(b.column(d).to_pylist()):
                    if x in where:
                        said[i] = np.log((1 - DECLARED_RIGHT) / max(n_lang - 1, 1))
                        said[i, where[x]] = np.log(DECLARED_RIGHT)
                post = _softmax(like + np.log(prior) + said)
                best = post.argmax(1)
                sure = np.where(count > 0, post[np.arange(m), best], 0.0)
                known = [sent.value.languages[k] if c else None for k, c in zip(best.tolist(), count.tolist(), strict=True)]
                good = (count > 0) & (best < n_lang - 1) & (sure >= ACCEPT)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(known, pa.string()), pa.array(sure), pa.array(good)], [*names, *new])

    added = T._parse_datatype_string("language string, language_confidence double, language_accepted boolean")
    return arrow_map(met, decide, T.StructType([*df.select(*quoted).schema.fields, *added.fields]))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents by their text and their source; fitted on those that have a label."""
    return identify(docs, fit(docs), host=F.col("source"))


def known_language(docs: DataFrame, text: str, label: str, key: str, host: str) -> DataFrame:
    """The rows whose language is accepted, with their columns; all rows if none has a label, as nothing can be judged then."""
    model = fit(docs, text, label, key)
    if model.languages == (UNKNOWN,):
        return docs
    return identify(docs, model, text, F.col(host)).where("language_accepted").select(*docs.columns)


def identify_pages(pages: DataFrame, model: LanguageModel) -> DataFrame:
    """Pages by the text between their tags, their html element's lang attribute and the host of their address."""
    bare = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    said = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+(?:-[A-Za-z0-9]+)*)""", 1)
    return identify(pages.withColumn("page_text", bare), model, "page_text", host_of(F.col("url")), said)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identify_documents(docs).select("doc_id", "language", "language_confidence", "language_accepted")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(table(spark, sf_dir, "documents"))
    return identify_pages(table(spark, sf_dir, "pages"), model).select("page_id", "url", "language", "language_confidence", "language_accepted")


QUERIES, SQL = {"op9_language_id": op9_language_id, "llm_page_language": page_language}, {}
