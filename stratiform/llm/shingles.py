"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first, by the operator's own steps (`simhash`): the sets' fingerprints, their segments' bit counts, the range join on
the grid, and an exact check, here of the sets' similarity. The grid holds every pair at 4 bits or fewer. Its cells hold
many that differ by more, up to `REACH`, and those are checked too: a pair at the least similarity differs by about 10 bits and by
no more than 16 with a chance of 0.99, but only one in five such pairs shares a cell.

The rest is found exactly by min-wise hashes, among sets that no link joins yet. Candidates share one of `BANDS` keys, each made of
`ROWS` min-wise hashes of the set; a pair at the least similarity shares none with a chance of (1 - 0.8^5)^20, about 0.0004.

Equal sets meet only once, and only sets that share a key with another are looked at. In two rounds some sets stand for
their key, one at first and then four, and are compared, exactly, with those of the key's other sets that no component
joins to them yet. First come the sets that share their keys with most others: among copies of one text, each changed
elsewhere, that is the text itself, which joins them all. So copies give stars and not all pairs, and a pair is compared
once in a round, whatever keys it shares. Keys that still hold several components, such as those of texts that share a
passage but are not similar, are cut into blocks of about `BLOCK` sets, and two blocks at a time meet in a task, which
gives the links that join their components. No key's sets are ever gathered, and no pair of them is a row.

Defined results: words are lower-cased and split at white space; fewer words than a shingle make one shingle; null and
blank texts are one component; repeated rows share a component; null ids count only where no other id is in the
component, which is then null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import discard, own_names, written
from stratiform.llm.graph import components, keep_one, labelled, place
from stratiform.llm.simhash import STEP as PRINT_STEP
from stratiform.llm.simhash import links as grid_links
from stratiform.llm.simhash import majority

SHINGLE_WORDS, SEED = 5, 42
#: Least Jaccard similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 20, 5
#: Bits in which the fingerprints of a cell may differ, to be compared.
REACH = 16
#: Shingles whose min-wise hashes are taken at a time.
STEP = 4096
#: Sets of a block.
BLOCK = 256
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """The sorted different 64-bit hashes of a text's shingles."""
    joined = " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")
    if not joined:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in joined.split(b" ")])
    n = max(1, len(ends) - SHINGLE_WORDS + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; an empty one has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = (own >> np.uint64(32)).astype(np.uint32)
    least = np.min([(low[None, at : at + STEP] * _TIMES + _PLUS).min(1) for at in range(0, len(low), STEP)], 0).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], np.uint64).view(np.int64)


def fingerprint(own: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles; that of an empty one is 0."""
    return majority((own[at : at + PRINT_STEP].tobytes() for at in range(0, len(own), PRINT_STEP)), len(own))


def _marks(docs: DataFrame) -> DataFrame:
    """(id, tag, h, size, fp, bands): `h` stands for the set of shingles, `fp` is its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            h = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fps = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["id", "tag", "h", "size", "fp", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, tag long, h long, size long, fp long, bands array<long>")


def _sets(docs: DataFrame, each: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, own): the sets `wanted` (h), from the texts at their places."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["h", "own"])

    chosen = wanted.join(each, "h").select("h", F.col("place.id").alias("__id"), F.col("place.tag").alias("__tag"))
    texts = docs.join(chosen, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag"))).select("h", "text")
    return written(texts.mapInArrow(parse, "h long, own binary").dropDuplicates(["h"]), "sets")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v, cu, cv) whose sets u and v are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, bottom = SIMILAR
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                a, b = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared * bottom >= (len(both) - shared) * top)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("h").alias("u"), F.col("own").alias("a")), "u")
    both = first.join(sets.select(F.col("h").alias("v"), F.col("own").alias("b")), "v")
    return both.select("u", "v", "cu", "cv", "a", "b").mapInArrow(compare, "u long, v long, cu long, cv long")


def near_prints(each: DataFrame) -> DataFrame:
    """(u, v): pairs of the sets `each` (h, size, fp) by SimHash: those of equal fingerprints, as a star, and those that span what
    the grid joins of fingerprints within `REACH` bits, one set for each."""
    top, bottom = SIMILAR
    able = each.where("size > 0").select("h", "size", "fp")
    first = written(able.groupBy("fp").agg(F.min(F.struct("h", "size")).alias("r")).select("fp", F.col("r.h").alias("rep"), F.col("r.size").alias("rep_size")), "prints")
    met = written(grid_links(first, REACH), "grid").distinct()
    one, two = (first.select(F.col("fp").alias(fp), F.col("rep").alias(h), F.col("rep_size").alias(size)) for fp, h, size in (("u", "a", "m"), ("v", "b", "n")))
    near = met.join(one, "u").join(two, "v").select("a", "m", "b", "n")
    equal = able.join(first, "fp").where("h <> rep").select(F.col("h").alias("a"), F.col("size").alias("m"), F.col("rep").alias("b"), F.col("rep_size").alias("n"))
    found = near.union(equal).where(F.least("m", "n") * bottom >= F.greatest("m", "n") * top)
    return written(found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "near")


def trees(docs: DataFrame, each: DataFrame) -> DataFrame:
    """(node, root): the component of each of the sets `each` (h, place, size, fp, bands) of `docs` (id, tag, text) that meets another."""
    top, bottom = SIMILAR
    near = near_prints(each)
    keyed = each.select("h", "size", F.explode("bands").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    pairs = written(keyed.join(shared, "key").select("key", "h", "size", "n"), "pairs")
    known = written(pairs.groupBy("h").agg(F.sum("n").alias("met")), "met")
    left = written(pairs.drop("n").join(known, "h").select("key", "h", "size", "met", F.col("h").alias("c")), "left")
    discard(shared, pairs)
    nodes = written(known.select("h").union(near.select("u")).union(near.select("v")).distinct(), "nodes")
    sets = _sets(docs, each, nodes)
    alike = written(_similar(near.select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv")), sets), "links")
    roots, left = _joined(nodes.select(F.col("h").alias("node"), F.col("h").alias("root")), left, alike.select("cu", "cv"))
    discard(known, near)
    if left.isEmpty():
        discard(sets)
        return roots
    for turn in range(2):
        slot = F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(4**turn))
        stand = written(left.groupBy("key", slot.alias("slot")).agg(F.max(F.struct("met", "h", "size", "c")).alias("r")).select("key", F.col("r.h").alias("rep"), F.col("r.size").alias("rep_size"), F.col("r.c").alias("rep_c")), "stand")
        able = (F.least("size", "rep_size") * bottom >= F.greatest("size", "rep_size") * top) & (F.col("c") != F.col("rep_c"))
        wanted = left.join(stand, "key").where(able).select(F.greatest("h", "rep").alias("u"), F.least("h", "rep").alias("v"), F.least("c", "rep_c").alias("cu"), F.greatest("c", "rep_c").alias("cv")).distinct()
        found = written(_similar(wanted, sets), "links")
        left = left.join(stand.select("key", F.col("rep").alias("h")), ["key", "h"], "left_anti")
        roots, left = _joined(roots, left, found.select("cu", "cv"))
        if left.isEmpty():
            discard(sets)
            return roots
    links = _met(left, sets)
    discard(sets)
    return _joined(roots, left, links)[0]


def _joined(roots: DataFrame, left: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`roots` and `left` after links between components; of `left` the keys that still hold several."""
    joined = written(components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).toDF("c", "new"), "joined")
    roots = written(roots.join(joined.toDF("root", "new"), "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
    left = written(left.join(joined, "c", "left").select("key", "h", "size", "met", F.coalesce("new", "c").alias("c")), "left")
    several = written(left.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("key", "n"), "several")
    return roots, written(left.join(several.select("key"), "key", "left_semi"), "left")


def _met(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(cu, cv): links that join the components of each key's sets, from blocks that meet two at a time."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for *cell, part, c, own in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if cell != at and held:
                    yield _links(held)
                    held = []
                at = cell
                held.append((part, c, np.frombuffer(own.as_py(), np.uint64)))
        if held:
            yield _links(held)

    sizes = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = left.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    cells = placed.select("key", "h", "c", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "h", "c", "part")
    dealt = cells.join(sets, "h").select("key", "i", "j", "part", "c", "own").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(dealt.mapInArrow(meet, "cu long, cv long"), "links")


def _links(cell: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """Links that join the components of two blocks' sets, or of one's, as (part, component, set) rows."""
    top, bottom = SIMILAR
    cell.sort(key=lambda row: row[0])
    parts, sets = np.array([row[0] for row in cell]), [row[2] for row in cell]
    group = np.array([row[1] for row in cell])
    sizes, found, alone = np.array([len(x) for x in sets]), [], parts[0] == parts[-1]
    for x, own in enumerate(sets):
        # Pairs within a block meet where it meets itself.
        rest = np.arange(x + 1, len(sets)) if alone else np.flatnonzero(parts > parts[x])
        rest = rest[(group[rest] != group[x]) & (np.minimum(sizes[rest], len(own)) * bottom >= np.maximum(sizes[rest], len(own)) * top)]
        if not len(rest):
            continue
        flat = np.concatenate([sets[i] for i in rest.tolist()])
        same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        shared = np.add.reduceat(same, np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]), dtype=np.int64)
        for y in rest[shared * bottom >= (sizes[rest] + len(own) - shared) * top].tolist():
            if group[x] != group[y]:
                found.append((min(group[x], group[y]), max(group[x], group[y])))
                group[group == group[y]] = group[x]
    return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], ["cu", "cv"])


def _found(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(id, tag, least), the least place of each row's component, and the scratch tables that are read for it."""
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    marks = written(_marks(docs), "marks")
    each = written(marks.groupBy("h").agg(F.min(place("id", "tag")).alias("place"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "different")
    labels = labelled(each.select(F.col("h").alias("node"), "place"), trees(docs, each))
    discard(each)
    return marks.join(labels.withColumnRenamed("node", "h"), "h").select("id", "tag", "least"), [marks, labels]


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, component_id): component_id is the least id reachable over similar texts; `tag` is the text's xxhash64."""
    return _found(df, id_col, text_col)[0].select(F.col("id").alias(id_col), "tag", F.col("least.id").alias("component_id"))


@own_names()
def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `df` for each component: the one of least id, null last, and of rows with that id one by its text."""
    found, scratch = _found(df, id_col, text_col)
    kept = keep_one(df, found, id_col, text_col)
    discard(*scratch)  # keep_one has written what it needs of them
    return kept
