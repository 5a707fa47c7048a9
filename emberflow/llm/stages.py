"""The stages of the corpus pipeline: each keeps or mends documents and returns the columns it got.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables (they stay empty) and
columns of any name beside those of ``documents``: columns are numbered while a stage works. Ties are settled by
the operators, whose docstrings tell how.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberflow.llm.common import fresh, table
from emberflow.llm.decontaminate import decontaminate
from emberflow.llm.language_id import known_language
from emberflow.llm.line_dedup import line_dedup
from emberflow.llm.ngram_join import ngram_join
from emberflow.llm.sentencepiece_codec import encode_texts, model_path


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``docs`` with its columns renamed to c0, c1, ..., these names, and the new name of each old one."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, dict(zip(docs.columns, names, strict=True))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or in no known language go. Without any labelled
    document no language is known and all stay."""
    plain, _, at = _numbered(docs)
    return known_language(plain, at["text"], at["lang"], at["doc_id"], at["source"]).toDF(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted, n_chars follows; documents of which nothing but white space is left go."""
    plain, names, at = _numbered(docs)
    text, n_chars = at["text"], at["n_chars"]
    cut = line_dedup(plain, text, at["doc_id"])
    changed = F.col("n_deleted") > 0
    length = F.when(changed, F.length(text).cast(plain.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    kept = cut.where(~(changed & (F.trim(F.col(text)) == "")))
    return kept.select(*(length.alias(c) if c == n_chars else F.col(c) for c in names)).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest identifier (null last); of rows that
    repeat an identifier and a text the first by a hash of all columns."""
    plain, names, at = _numbered(docs)
    doc_id = F.col(at["doc_id"])
    key = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64(at["text"]).alias("hash"))
    kind = f"struct<none: boolean, id: {plain.schema[at['doc_id']].dataType.simpleString()}, hash: bigint>"
    keyed = plain.withColumn("key", key.cast(kind))  # fields may be null, as those read again may, so both sides are dealt alike
    found = ngram_join(keyed.select("key", at["text"]), at["text"], "key")
    kept = found.where(F.col("key") == F.col("class_id")).select("key").distinct()
    content = F.xxhash64(*(c for c in names if "map<" not in plain.schema[c].dataType.simpleString()))
    only = keyed.groupBy("key").agg(F.min_by(F.struct(*names), content).alias("row"))  # the one shuffle of whole rows
    return only.join(kept, "key", "left_semi").select("row.*").toDF(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    plain, names, at = _numbered(docs)
    found = decontaminate(plain, table(spark, sf_dir, "benchmark"), at["text"], carry=names)
    return found.where(~F.col("contaminated")).select(*names).toDF(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces' ids, the number of these and whether they decode to the text."""
    new = fresh(docs.columns, "token_ids", "n_tokens", "round_trip")
    plain, names, at = _numbered(docs)
    return encode_texts(plain, model_path(), at["text"], names).toDF(*docs.columns, *new)
