"""Byte-level BPE encoding and decoding.

Merges run on a segment tree over byte positions: a leaf holds the rank of the pair that starts there, an inner
node the leftmost minimum below it, so the root names the next merge and a merge changes at most three leaves, each
in logarithmic time. Pieces of text repeat, so a worker keeps the ids of the short ones it has met lately, between
`CACHE_PIECES` and twice as many.

Defined results: a null text is the empty text, which has no ids and decodes to no bytes; a piece of any length
is merged in O(n log n); repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Pieces whose ids a worker keeps, and the longest piece that it keeps (characters).
CACHE_PIECES, CACHE_CHARS = 300_000, 48
_NONE = 1 << 62


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get, width = ranks.get, 1 << (n - 2).bit_length()
    ends, befores = [*range(1, n + 1), n], list(range(-1, n))
    tree = [_NONE] * (2 * width)
    # A leaf is the rank and the place of the pair of the token at i with its live neighbour, as one number.
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    while (top := tree[1]) != _NONE:
        left = top % width
        right = ends[left]
        middle = ends[left] = ends[right]
        befores[middle] = left
        changed = [left]
        rank = get(piece[left : ends[middle]]) if middle < n else None
        tree[width + left] = _NONE if rank is None else rank * width + left
        if right < n - 1:
            tree[width + right] = _NONE
            changed.append(right)
        before = befores[left]
        if before >= 0:
            rank = get(piece[before:middle])
            tree[width + before] = _NONE if rank is None else rank * width + before
            changed.append(before)
        for i in changed:
            node = width + i >> 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                if b < a:
                    a = b
                if tree[node] == a:
                    break
                tree[node] = a
                node >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class _Pieces(dict):
    """Ids by piece; an absent piece is merged, and kept if it is short."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece) or tuple(merge(piece.encode(), self.ranks))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes with the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.pieces = _Pieces(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _vocabulary(spark: SparkSession, ranks_path: str):
    """The file as a broadcast: a vocabulary has a fixed size, under a megabyte here."""
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row."""
    raw = _vocabulary(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(raw.value), pattern)
        for batch in batches:
            ids = [codec.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, content binary) for each row; null ids are no ids."""
    raw = _vocabulary(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(raw.value), "")
        for batch in batches:
            content = [codec.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], ["id", "content"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"id {kind}, content binary").withColumnRenamed("id", id_col)


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that ids need not leave the worker."""
    raw = _vocabulary(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(raw.value), pattern)
        names = {rank: str(rank) for rank in codec.tokens}
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
