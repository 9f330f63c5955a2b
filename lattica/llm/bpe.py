"""Problem 7: encoding of a corpus with a public byte-pair vocabulary.

A piece of the pattern is encoded by a segment tree over its byte positions
whose leaves hold the rank of the pair that starts there; the root is the
leftmost smallest rank, and a merge updates the leaves of its live neighbours.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabularies; a parameter, never part of the repository.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published splitting pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept encoded in a worker; beyond that the memory starts anew.
REMEMBERED = 200_000

_NONE = 1 << 62


class Encoder:
    """Byte-pair encoder over ranks; deterministic, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.split, self.known = ranks, regex.compile(pattern), {}

    @classmethod
    def parse(cls, content: bytes) -> Encoder:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)})

    def piece(self, piece: bytes) -> list[int]:
        n, ranks = len(piece), self.ranks
        if n == 1:
            return [ranks[piece]]
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        # a leaf packs rank and position, so that the smaller of two is the smaller rank, then the one further left
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = r << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        ends = list(range(1, n + 1))  # of the live token that starts at i
        before = list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        def pair(i: int) -> int:
            j = ends[i]
            if j >= n:
                return _NONE
            r = ranks.get(piece[i : ends[j]])
            return _NONE if r is None else r << 32 | i

        while (top := tree[1]) != _NONE:
            i = top & 0xFFFFFFFF
            j = ends[i]
            ends[i] = ends[j]
            if ends[j] < n:
                before[ends[j]] = i
            put(j, _NONE)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for w in self.split.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = self.piece(w.encode())
                if len(w) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = ids
            out += ids
        return out


def vocabulary(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The vocabulary file as a broadcast: its size is fixed (about 1 MB), whatever the corpus."""
    with open(f"{folder}/{name}", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids ARRAY<INT>): token ids of each text; null and empty texts give an empty list. No shuffle."""
    content = vocabulary(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.parse(content.value)
        for batch in batches:
            ids = pa.array((coder.encode(t) for t in batch.column(1).to_pylist()), pa.list_(pa.int32()), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    own = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id, tokens INT): the number of token ids of each text, counted in the workers."""
    content = vocabulary(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.parse(content.value)
        for batch in batches:
            sizes = pa.array([len(coder.encode(t)) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], [id_col, "tokens"])

    own = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, tokens int")
