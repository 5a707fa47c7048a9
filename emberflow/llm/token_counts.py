"""Token counts of whole texts with a public tokenizer: Arrow functions that return lengths only.

Batches are balanced by bytes. Texts are split at safe boundaries: the tokenizer drops white space before
it merges, so no token crosses it, and a text's count is the sum over its chunks between white space. A
worker remembers the counts of frequent chunks; its memory is bounded. Texts that hold one of the
tokenizer's special strings, or characters that are white space for Python only, go to the library whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm.common import arrow_map, table
from emberflow.llm.textkit import slices

#: Remembered chunks a worker, and the longest chunk that is remembered.
CACHE, CACHED_CHARS = 1_000_000, 64
#: A chunk that occurs so often in a slice is counted by itself and remembered.
OFTEN = 2
#: Characters of a long text, and of all texts, that go to the library in one call, roughly.
PIECE, CALL = 1 << 18, 1 << 21
#: White space for Python's split, but not for the tokenizer's pattern.
_ODD = re.compile("[\x1c-\x1f]")
_loaded: dict[str, tuple] = {}


def _counter(path: str) -> tuple:
    """(function from texts to counts, special strings, whether white space separates tokens) of a file."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], [], False)
        else:
            import json
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task is one core
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            special = [x["content"] for x in spec.get("added_tokens") or []]
            said = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
            apart = '"end_of_word_suffix": "</w>"' in json.dumps({k: v for k, v in spec["model"].items() if k == "end_of_word_suffix"}) and "\\\\s+" in said and '"behavior": "Removed"' in said
            one = getattr(model, "encode_batch_fast", model.encode_batch)
            _loaded[path] = (lambda texts: [len(x) for x in one(texts, add_special_tokens=False)], special, apart)
    return _loaded[path]


def count_tokens(texts: list[str], path: str, known: dict[str, int]) -> list[int]:
    """The tokens of each text; ``known`` is the worker's memory of frequent chunks.

    Chunks that occur OFTEN times among these texts are counted once and remembered; the rest of each text
    goes to the library joined by single spaces, long ones in bounded pieces that are cut at such a space.
    """
    count, special, apart = _counter(path)
    if not apart:
        return count(texts)
    whole = [i for i, t in enumerate(texts) if any(s in t for s in special) or _ODD.search(t)]
    out, rest, at = [0] * len(texts), [""] * len(texts), set(whole)
    for i in whole:
        rest[i] = texts[i]
    if len(known) > CACHE:
        known.clear()
    parts = [[] if i in at else t.split() for i, t in enumerate(texts)]
    new = [[c for c in p if c not in known] for p in parts]
    often = [c for c, n in Counter(chain.from_iterable(new)).items() if n >= OFTEN and len(c) <= CACHED_CHARS]
    for k in range(0, len(often), 20_000):
        some = often[k : k + 20_000]
        known.update(zip(some, count(some), strict=True))
    get = known.get
    for i, p in enumerate(parts):
        if p:
            out[i] = sum(get(c, 0) for c in p)
            rest[i] = " ".join(c for c in new[i] if c not in known)
    owners, pieces = [], []
    for i, t in enumerate(rest):
        for piece in [t] if i in at else _pieces(t):
            owners.append(i)
            pieces.append(piece)
    for a, b in _calls(pieces):
        for i, n in zip(owners[a:b], count(pieces[a:b]), strict=True):
            out[i] += n
    return out


def _pieces(text: str) -> list[str]:
    """``text`` cut at spaces into pieces of PIECE characters, longer only where it has no space."""
    out, begin = [], 0
    while begin < len(text):
        end = text.find(" ", begin + PIECE)
        end = len(text) if end < 0 else end
        out.append(text[begin:end])
        begin = end + 1
    return out


def _calls(pieces: list[str]) -> list[tuple[int, int]]:
    """Ranges of pieces for one call of the library each, of about CALL characters."""
    out, begin, size = [], 0, 0
    for k, t in enumerate(pieces):
        size += len(t)
        if size >= CALL:
            out.append((begin, k + 1))
            begin, size = k + 1, 0
    return [*out, (begin, len(pieces))] if begin < len(pieces) else out


def token_counts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """(``key``, n_bytes, n_tokens, over_limit) of each row: UTF-8 bytes, tokens of the whole text without
    added special tokens, truncation or padding, and whether there are more than ``limit``.

    Null and empty texts have 0 of both. Special strings inside texts count as the library takes them by
    default. Rows keep their identifiers, null or repeated; other columns are ignored. An empty table gives no rows. No
    shuffle.
    """
    narrow = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", narrow.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                texts = pc.fill_null(b.column("text"), "")
                yield pa.RecordBatch.from_arrays([b.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(count_tokens(texts.to_pylist(), path, known), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return arrow_map(narrow, measure, schema).select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES, SQL = {"op5_token_counts": op5_token_counts}, {}
