"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The model file is read here (pieces, scores, types and the normaliser's switches). A text's white space
becomes the marker; the text falls into units that no piece can span, so the best segmentation of a text is
that of its units in turn, and a worker remembers the units it has met. In a unit, every character position
walks the trie over the UTF-8 bytes; a character that is no piece by itself may stand for an unknown piece,
which is ten below the least score, and is written as byte pieces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.llm.common import arrow_map, fresh, table
from emberflow.llm.textkit import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Units that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 700_000, 48
_UNREACHED = -1e300


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffers message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class DoubleArray:
    """A trie of byte strings in two arrays: child(s, c) = base[s] + c + 1 if check of that is s. Index 0 of a
    node's children (c = -1) is its end, whose base is -1 - value."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check = [0] * 1024, [-1] * 1024
        self.check[0] = len(self.check)  # taken, and no node's child
        order = sorted(keys)
        todo = [(0, 0, len(order), 0)]
        low = 1
        while todo:
            node, a, b, depth = todo.pop()
            children: list[tuple[int, int, int]] = []
            i = a
            if i < b and len(order[i]) == depth:
                children.append((0, i, i + 1))
                i += 1
            while i < b:
                c, j = order[i][depth], i + 1
                while j < b and order[j][depth] == c:
                    j += 1
                children.append((c + 1, i, j))
                i = j
            start = max(low, children[0][0] + 1) - children[0][0]
            while True:
                self._grow(start + 257)
                if self.check[start + children[0][0]] < 0 and all(self.check[start + c] < 0 for c, _, _ in children):
                    break
                start += 1
            if len(children) == 1 or start > low + 4096:
                low = max(low, start - 2048 if len(children) > 1 else low)
            while self.check[low] >= 0:
                low += 1
                self._grow(low + 257)
            self.base[node] = start
            for c, _, _ in children:
                self.check[start + c] = node
            for c, i, j in children:
                if c == 0:
                    self.base[start] = -1 - keys[order[i]]
                else:
                    todo.append((start + c, i, j, depth + 1))

        #: The value that ends at each node, or -1.
        self.ends = [-1] * len(self.base)
        for node, parent in enumerate(self.check):
            if parent >= 0 and self.base[parent] == node and self.base[node] < 0:
                self.ends[parent] = -1 - self.base[node]

    def _grow(self, n: int) -> None:
        if n > len(self.base):
            more = max(n, 2 * len(self.base)) - len(self.base)
            self.base += [0] * more
            self.check += [-1] * more

    def walk(self, data: bytes, start: int = 0) -> Iterator[tuple[int, int]]:
        """(end, value) of each key that begins at ``start``, shortest first."""
        node = 0
        for at in range(start, len(data)):
            child = self.base[node] + data[at] + 1
            if self.check[child] != node:
                return
            node = child
            if self.ends[node] >= 0:
                yield at + 1, self.ends[node]


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        self.dummy_prefix, self.shrink, self.byte_fallback = True, True, False
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                self.byte_fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("only the identity normaliser is supported")
                self.dummy_prefix, self.shrink = bool(f.get(3, 1)), bool(f.get(4, 1))
                if not f.get(5, 1):
                    raise ValueError("white space must be escaped")
        self.kinds = kinds
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (NORMAL, USER)}
        self.trie = DoubleArray({p.encode(): i for p, i in normal.items()})
        self.singles = {p.encode() for p in normal if len(p) == 1}
        self.scores = scores
        self.unknown_score = min(scores[i] for i in normal.values()) - UNKNOWN_PENALTY
        inner = any(MARK in p.lstrip(MARK) for p in normal)  # a marker behind other characters
        joined = {c for p in normal if len(p) > 1 for c in p}
        alone = "".join(c for c in map(chr, range(128)) if c not in joined)
        self.units = None if inner else re.compile(f"{MARK}+[^{MARK}{re.escape(alone)}]*|[^{MARK}{re.escape(alone)}]+|[{re.escape(alone)}]")

    def normalise(self, text: str) -> str:
        if self.shrink:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    def encode_unit(self, unit: str) -> list[int]:
        """The best segmentation; of equal ones, that whose last piece that differs is longest."""
        data = unit.encode()
        n = len(data)
        best, begin, piece = [_UNREACHED] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        base, check, ends, scores = self.trie.base, self.trie.check, self.trie.ends, self.scores
        for start in range(n):
            here = best[start]
            if here == _UNREACHED:  # inside a character
                continue
            node, at = 0, start
            while at < n:
                child = base[node] + data[at] + 1
                if check[child] != node:
                    break
                node = child
                at += 1
                value = ends[node]
                if value >= 0 and here + scores[value] > best[at]:
                    best[at], begin[at], piece[at] = here + scores[value], start, value
            first = data[start]
            single = start + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            if data[start:single] not in self.singles and here + self.unknown_score > best[single]:
                best[single], begin[single], piece[single] = here + self.unknown_score, start, -1
        out: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in reversed(data[begin[at] : at]))
            else:
                out.append(self.unknown)
            at = begin[at]
        return out[::-1]

    def encode(self, text: str, known: dict[str, bytes] | None = None) -> np.ndarray:
        known = {} if known is None else known
        norm = self.normalise(text)
        units = self.units.findall(norm) if self.units else [norm] if norm else []
        parts = []
        for u in units:
            ids = known.get(u)
            if ids is None:
                ids = np.array(self.encode_unit(u), np.int32).tobytes()
                if len(u) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[u] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of some ids: markers become spaces, runs of byte pieces UTF-8 (U+FFFD where they aren't), control pieces nothing."""
        surface, is_byte = self._surfaces()
        ids = np.asarray(ids, np.int64)
        if not is_byte[ids].any():
            out = "".join(map(surface.__getitem__, ids.tolist()))
        else:
            parts: list[bytes] = []
            for i in ids.tolist():
                parts.append(bytes((int(self.pieces[i][3:5], 16),)) if self.kinds[i] == BYTE else surface[i].encode())
            out = b"".join(parts).decode("utf-8", "replace")
        out = out.replace(MARK, " ")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out

    def _surfaces(self) -> tuple[list[str], np.ndarray]:
        if not hasattr(self, "_surface"):
            self._surface = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p for p, k in zip(self.pieces, self.kinds, strict=True)]
            self._is_byte = np.array([k == BYTE for k in self.kinds])
        return self._surface, self._is_byte


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(f.read())
    return _codecs[path]


def encode_texts(df: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row's ``carry`` columns (default all) and token_ids, n_tokens and round_trip.

    ``path`` is a model file at the same place on every machine. round_trip tells whether decoding the ids
    gives the text again, with each marker character of the text as a space (and white space shrunk where the
    model shrinks it). Null and empty texts have no tokens. Whole texts are encoded, whatever their
    length. Carried columns named like the new ones are left out. No shuffle; an empty table stays empty.
    """
    new = ("token_ids", "n_tokens", "round_trip")
    carry = [c for c in (carry or df.columns) if c.lower() not in new]
    (body,) = fresh(carry, "body")
    quoted = [F.col(f"`{c}`") for c in carry]
    if text in carry:  # the text goes to the workers once
        body, rows = text, df.select(*quoted)
    else:
        rows = df.select(*quoted, F.col(text).alias(body))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known = codec(path), {}
        for whole in batches:
            for b in slices(whole, body):
                texts = pc.fill_null(b.column(body), "").to_pylist()
                ids = [c.encode(t, known) for t in texts]
                want = (c.normalise(t).replace(MARK, " ")[int(c.dummy_prefix) :] for t in texts)
                same = [c.decode(i) == w for i, w in zip(ids, want, strict=True)]
                off = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), lists, pa.array(np.diff(off).astype(np.int64)), pa.array(same, pa.bool_())], [*carry, *new])

    more = T._parse_datatype_string("token_ids array<int>, n_tokens bigint, round_trip boolean")
    return arrow_map(rows, work, T.StructType([*(rows.schema[c] for c in carry), *more.fields]))


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", carry: list[str] | None = None) -> DataFrame:
    """Each row's ``carry`` columns (default all but ``ids``) and decoded_text; null ids give null."""
    carry = [c for c in (carry or df.columns) if c.lower() not in (ids.lower(), "decoded_text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = [None if i is None else c.decode(i) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in carry), pa.array(out, pa.string())], [*carry, "decoded_text"])

    rows = df.select(*(F.col(f"`{c}`") for c in [*carry, ids]))
    return arrow_map(rows, work, T.StructType([*(rows.schema[c] for c in carry), T.StructField("decoded_text", T.StringType())]))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), model_path(), carry=["doc_id"])


QUERIES, SQL = {"op4_sentencepiece": op4_sentencepiece}, {}
