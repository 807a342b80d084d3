"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint has `64 / 2` segments of two bits; its embedding is the vector of their bit counts. The Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints, so it bounds candidates from below.
The range join runs on a grid: the segments form `GROUPS` groups, and two vectors within Manhattan distance
`GROUPS - EQUAL` agree on `EQUAL` whole groups at least, so each fingerprint goes to one cell for each choice of
`EQUAL` groups. Pairs of a cell pass the Manhattan bound and then the exact Hamming distance.

Copies meet only once: cells hold different fingerprints, and a cell gives a spanning forest of its links, not all
pairs. Components come from star contractions over those links.

Defined results: a null or blank text has fingerprint 0 and is linked like any other; fewer words than a shingle
make one shingle; repeated rows share a component; null ids count only where no other id is in the component, which
is then null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import own_names, written
from stratiform.llm.graph import components, keep_one, labelled, place

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Groups of segments, and how many of them a cell fixes: 35 cells for each fingerprint.
GROUPS, EQUAL = 7, 3
#: A larger cell is searched breadth first instead of pair by pair.
SMALL_CELL = 16
#: Shingles that are hashed at a time.
STEP = 65_536


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SHINGLE_WORDS + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[SHINGLE_WORDS - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    parts = (b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + STEP], stops[lo : lo + STEP], strict=True)]) for lo in range(0, n, STEP))
    return majority(parts, n)


def majority(parts: Iterable[bytes], n: int) -> int:
    """The number whose bits are those set in over half of the `n` 64-bit hashes that the parts hold."""
    set_bits = np.zeros(64, np.int64)
    for hashes in parts:
        set_bits += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, fp long): the text's xxhash64, and the fingerprint's bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values)], ["id", "tag", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tag long, fp long")


# ---------------------------------------------------------------- grid range join


def embedding(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, in unary, so that Manhattan distances are bit counts of differences."""
    even = np.uint64(0x5555555555555555)
    low, high = fps & even, fps >> np.uint64(1) & even
    return low | high | (low & high) << np.uint64(1)


def cells(points: np.ndarray) -> np.ndarray:
    """(points, choices) keys of the cells of each embedded fingerprint; keys that collide only add candidates."""
    segments = np.array_split(np.arange(32), GROUPS)
    masks = [np.uint64(sum(3 << 2 * int(s) for s in own)) for own in segments]
    keys = []
    for i, chosen in enumerate(combinations(range(GROUPS), EQUAL)):
        key = (points & np.bitwise_or.reduce([masks[g] for g in chosen])) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i * 0xBF58476D1CE4E5B9 % 2**64)
        key ^= key >> np.uint64(29)
        keys.append(key * np.uint64(0x94D049BB133111EB))
    return np.stack(keys, 1)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the pairs whose embeddings are within the bound and whose fingerprints are within `bits`."""
    some = np.flatnonzero(np.bitwise_count(embedding(a) ^ embedding(b)) <= bits)
    return some[np.bitwise_count(a[some] ^ b[some]) <= bits]


def _spread(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a cell's links: each found fingerprint searches those that no tree holds yet."""
    froms, tos, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.zeros(len(rest), bool)
            hit[_near(np.broadcast_to(x, rest.shape), rest, bits)] = True
            if hit.any():
                froms.append(np.full(int(hit.sum()), x))
                tos.append(rest[hit])
                queue.extend(rest[hit])
                rest = rest[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *froms]), np.concatenate([none, *tos])


def links_of(keys: np.ndarray, fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the fingerprints that share cells."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(firsts, len(keys)))
    froms, tos = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    at = np.flatnonzero(np.repeat(sizes <= SMALL_CELL, sizes))
    for shift in range(1, SMALL_CELL):
        at = at[at + shift < len(keys)]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        hit = at[_near(fps[at], fps[at + shift], bits)]
        froms.append(fps[hit])
        tos.append(fps[hit + shift])
    for first, size in zip(firsts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
        a, b = _spread(np.unique(fps[first : first + size]), bits)
        froms.append(a)
        tos.append(b)
    return _forest(np.concatenate(froms), np.concatenate(tos))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that join trees, in a union-find over all of them."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            kept.append((x, y))
    both = np.array(kept, np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(u, v): links that span the components of the different fingerprints `fps` (fp long)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(own), 4096):
                part = own[lo : lo + 4096]
                keys = cells(embedding(part))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], ["cell", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)) for b in batches]
        if got:
            u, v = links_of(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), bits)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return fps.select("fp").mapInArrow(deal, "cell long, fp long").repartition("cell").mapInArrow(meet, "u long, v long")


def _found(df: DataFrame, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, fp, least): the least place of each row's component."""
    docs = written(fingerprints(df, id_col, text_col), "fingerprints")
    each = written(docs.groupBy(F.col("fp").alias("node")).agg(F.min(place("id", "tag")).alias("place")), "different")
    labels = labelled(each, components(links(each.select(F.col("node").alias("fp")), bits)))
    return docs.join(labels.withColumnRenamed("node", "fp"), "fp")


def near_duplicates(df: DataFrame, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the least id reachable over fingerprints that differ in at most `bits` bits."""
    return _found(df, bits, id_col, text_col).select(F.col("id").alias(id_col), "fp", F.col("least.id").alias("component_id"))


@own_names()
def dedup(df: DataFrame, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `df` for each component: the one of least id, null last, and of rows with that id one by its text."""
    return keep_one(df, _found(df, bits, id_col, text_col), id_col, text_col)
