"""Sharding by minimax contiguous partition.

Rows with equal texts are an atomic group. Groups are ordered by a 64-bit hash of their text and cut into
contiguous shards: a binary search finds the smallest capacity for which a greedy pass over the groups needs no more
shards than asked, and the cuts are then made within it, as near to equal sizes as that capacity allows.

The driver never sees all groups. It starts from the sums of at most `2 ** CELL_BITS` hash ranges. Taken as divisible
they give a lower bound of the capacity, taken as whole an upper one, and the ranges in which a cut may fall between
both bounds are divided further, until the bounds meet: then every cut is known to lie between two groups and the
capacity is the least over all groups. A range with one group is never divided, so the refinement ends.

Defined results: a null text has no bytes and size 1, like the empty text, with which it shares a group; repeated
rows each get a slot of their own; a null id sorts last; an empty table gives an empty result; a group larger than
a shard's share has a shard to itself as far as its neighbours allow; texts whose 64-bit hashes agree are one group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import ranked, size_of, written

#: The driver gets at most 2 ** CELL_BITS range sums at a time, 40 bytes each, and divides at most 2 ** SPLIT_BITS ranges.
CELL_BITS, SPLIT_BITS = 18, 12


def needed(ends: np.ndarray, capacity: int, shards: int) -> bool:
    """Whether a greedy pass over atoms that end at `ends` (running sums) needs at most `shards` shards."""
    at = 0
    for _ in range(shards):
        at = _floor(ends, at + capacity)
        if at == int(ends[-1]):
            return True
    return False


def _floor(ends: np.ndarray, x: int) -> int:
    """The last boundary at or before x; 0 is one."""
    k = int(np.searchsorted(ends, x, "right"))
    return int(ends[k - 1]) if k else 0


def _ceil(ends: np.ndarray, x: int) -> int:
    """The first boundary at or after x; 0 is one."""
    return 0 if x <= 0 else int(ends[int(np.searchsorted(ends, x, "left"))])


def minimax(sizes: list[int] | np.ndarray, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, atoms before each shard's end).

    Shards may be empty. Any boundary between the earliest and the latest feasible cut keeps the capacity; the
    one nearest below an equal share is taken.
    """
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return 0, [0] * shards
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    low, high = max(-(-total // shards), int(sizes.max())), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(ends, middle, shards) else (middle + 1, high)
    earliest = [total]
    for _ in range(shards - 1):
        earliest.append(_ceil(ends, earliest[-1] - low))
    earliest = earliest[::-1]
    cuts, at = [], 0
    for j in range(1, shards + 1):
        wish = _floor(ends, j * total // shards)
        after = _ceil(ends, j * total // shards)
        wish = after if after - j * total // shards < j * total // shards - wish else wish
        at = min(max(wish, earliest[j - 1], at), _floor(ends, at + low))
        cuts.append(int(np.searchsorted(ends, at, "right")) if at else 0)
    return low, cuts


@dataclass
class Ranges:
    """Hash ranges with texts, in order: first hash, bits that a range fixes, bytes, whether it is one group."""

    first: np.ndarray
    bits: np.ndarray
    sizes: np.ndarray
    single: np.ndarray

    def without(self, some: np.ndarray) -> Ranges:
        return Ranges(*(np.delete(x, some) for x in (self.first, self.bits, self.sizes, self.single)))

    @classmethod
    def of(cls, parts: list[Ranges]) -> Ranges:
        """All ranges of the parts, in order."""
        columns = [np.concatenate([getattr(p, k) for p in parts]) for k in ("first", "bits", "sizes", "single")]
        order = np.argsort(columns[0])
        return cls(*(x[order] for x in columns))


def _passes(ends: np.ndarray, single: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Where a greedy pass cuts if a cut may also fall anywhere inside a range that is no single group."""
    at, cuts = 0, []
    for _ in range(shards):
        at = min(at + capacity, int(ends[-1]))
        k = int(np.searchsorted(ends, at, "right"))
        if k < len(ends) and single[k]:
            at = int(ends[k - 1]) if k else 0
        cuts.append(at)
    return cuts


def lower_bound(ranges: Ranges, shards: int) -> int:
    """The smallest capacity if ranges of several groups could be cut anywhere."""
    ends = np.cumsum(ranges.sizes)
    low, high = -(-int(ends[-1]) // shards), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _passes(ends, ranges.single, middle, shards)[-1] == ends[-1] else (middle + 1, high)
    return low


def doubtful(ranges: Ranges, low: int, high: int, shards: int) -> np.ndarray:
    """The ranges of several groups in which a greedy pass of a capacity between `low` and `high` may cut, largest first."""
    ends = np.cumsum(ranges.sizes)
    starts, at, inside = ends - ranges.sizes, 0, np.zeros(len(ends), bool)
    for top in _passes(ends, ranges.single, high, shards):
        at = _floor(ends, at + low)  # no pass cuts before this one, which takes ranges as whole
        inside |= (starts < top) & (ends > at)
    some = np.flatnonzero(inside & ~ranges.single)
    return some[np.argsort(-ranges.sizes[some], kind="stable")][: 2**SPLIT_BITS]


def _sums(groups: DataFrame, first: np.ndarray, bits: np.ndarray, more: int) -> Ranges:
    """The sums of the ranges that the given ones are divided into, each by `more` bits."""
    parts = []
    for own in np.unique(bits).tolist():
        h, cell = F.col("hash"), F.shiftright("hash", max(0, 64 - own - more))
        some = groups
        if own:
            wanted = groups.sparkSession.createDataFrame([(int(x) >> (64 - own),) for x in first[bits == own]], "range long")  # at most 2 ** SPLIT_BITS rows
            some = groups.join(F.broadcast(wanted), F.shiftright(h, 64 - own) == F.col("range"), "left_semi")
        found = some.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("least"), F.max("hash").alias("most")).toArrow()
        cell, sizes, least, most = (found.column(k).to_numpy().astype(np.int64) for k in range(4))
        fixed = min(64, own + more)
        parts.append(Ranges(cell << (64 - fixed), np.full(len(cell), fixed), sizes, least == most))
    return Ranges.of(parts)


def cuts_of(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, first hash of each shard but the first) for (hash, bytes) rows, one for each group.

    A shard without groups starts where the next one does, or past all hashes.
    """
    ranges = _sums(groups, np.zeros(1, np.int64), np.zeros(1, np.int64), CELL_BITS)
    if not len(ranges.sizes):
        return 0, []
    while True:
        low, (high, cuts) = lower_bound(ranges, shards), minimax(ranges.sizes, shards)
        some = doubtful(ranges, low, high, shards) if low < high else []
        if not len(some):
            return high, [int(ranges.first[c]) for c in cuts[:-1] if c < len(ranges.first)]
        more = max(1, CELL_BITS - int(np.ceil(np.log2(len(some)))))
        ranges = Ranges.of([ranges.without(some), _sums(groups, ranges.first[some], ranges.bits[some], more)])


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row; size is the text's UTF-8 bytes plus 1.

    Texts are read once: hashes and sizes go to a narrow table, from which groups, slots and the result come.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = written(
        df.select(F.col(id_col).alias("__id"), (size_of(text_col) + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("__hash")),
        "sizes",
    )
    groups = written(narrow.groupBy(F.col("__hash").alias("hash")).agg(F.sum("size").alias("bytes")), "groups")
    _, firsts = cuts_of(groups, shards)
    shard_of = sum((F.when(F.col("__hash") >= F.lit(first), 1).otherwise(0) for first in firsts), F.lit(0)).cast("int")
    placed = narrow.withColumn("shard", shard_of)
    return ranked(placed, "shard", ["__id", "__hash"], "slot", narrow.count()).select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
