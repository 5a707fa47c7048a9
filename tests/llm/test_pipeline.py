"""The corpus pipeline on planted cases, and each stage on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberflow.llm import stages

RND = random.Random(21)
LETTERS = {"en": "etaoinshrdlu", "de": "enirsäüößtch"}


def prose(k, n):
    return " ".join("".join(RND.choices(LETTERS[k], k=RND.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    clean = [(i, prose("en" if i % 3 else "de", 80)) for i in range(60)]
    passage, item = prose("en", 60), prose("en", 30)
    rows = list(clean)
    rows += [(100, clean[1][1]), (101, clean[2][1].replace(" ", "  ", 1) + " extra")]  # an exact and a near copy
    rows += [(102, prose("en", 40) + "\n" + passage), (103, prose("en", 40) + "\n" + passage + "\n" + prose("en", 40))]
    rows += [(104, prose("en", 20) + " " + item + " " + prose("en", 20)), (105, "123 !!"), (106, None)]
    folder = tmp_path_factory.mktemp("planted")
    lang = F.when(F.col("doc_id") < 60, F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": lang, "source": F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")), "n_chars": F.length("text").cast("bigint")})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, passage


def test_pipeline(spark, planted):
    folder, rows, passage = planted
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(range(60)) | {102, 103}  # copies, the leak and what has no language are gone
    texts = dict(rows)
    assert all(got[i].text == texts[i] and got[i].round_trip and got[i].n_chars == len(texts[i]) for i in [*range(60), 102])
    assert passage not in got[103].text and got[103].text.count("\n") == 1 and got[103].n_chars == len(got[103].text)


def test_stages_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "sentencepiece"]


@pytest.mark.parametrize("stage", [stages.language_stage, stages.line_stage, stages.near_duplicate_stage, stages.benchmark_stage, stages.encode_stage])
def test_stages_take_odd_rows(spark, planted, stage):
    folder, _, _ = planted
    base = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"row": F.lit(1), "key": F.lit("k"), "n_words": F.lit(2), "body": F.lit("b"), "host": F.lit("h"), "n_lines": F.lit(5)})
    odd = base.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("n_chars"), "row", "key", "n_words", "body", "host", "n_lines")
    docs = base.unionByName(odd).unionByName(base.where("doc_id = 5"))
    out = stage(spark, docs, folder)
    want = docs.columns if stage is not stages.encode_stage else [*docs.columns, "token_ids", "n_tokens", "round_trip"]
    assert out.columns == want
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert set(range(60)) <= set(ids) and {(r.row, r.key, r.n_words, r.n_lines) for r in out.select("row", "key", "n_words", "n_lines").collect()} == {(1, "k", 2, 5)}
    assert ids.count(5) == (1 if stage is stages.near_duplicate_stage else 2)
    assert stage(spark, docs.where("false"), folder).count() == 0
