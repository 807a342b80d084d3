"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the lower-cased words of the labelled sample, all of them; document frequencies are counted over all texts.
A term weighs (1 + ln tf) * ln(texts / texts with it) * relevance. The relevance is 1 for a term that both classes share or that few examples
hold, and grows with the lower confidence bound of the log of its rates in toxic and other examples: without it, the
thousands of rare words of a text drown the few that tell the classes apart. The sample forms an inverted index whose
blocks of `BLOCK` examples store each term's greatest weight; a query adds these up to bound a block's cosines, visits
those of the best bounds first and then the others that can still reach its `NEIGHBOURS` best. Terms of more than one in
`COMMON` examples, whose lists are most of the index, are held as a matrix instead and multiplied for `TOGETHER` queries
at once, so a block's bound has their sums exactly. The cosines of all that may be among the best are then computed in
full precision, so the neighbours are exact. An example is never its own neighbour. Similarity-weighted votes, with the weight of each class,
become a rate by an isotonic fit over the votes of examples. One example in `PARTS` is kept from the choice of
relevances, and the fit is on these, which the choice cannot flatter.

The sample is bounded: at most `PER_CLASS` labelled rows of class 0 and of class 1, those of least hash. Nothing else is.

Defined results: a text that shares no term with an example, or only such as all texts have (also a null, blank or
empty one), gets the rate of such examples; ties between neighbours go to the one that comes first in the index; repeated rows get equal scores, unless
one of them is an example; of several texts of a labelled id the one of least hash is the example; labels other than 0
and 1, and labels without a document, are not learned from, and of several labels of an id the greatest counts; without
labelled rows all scores are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import discard, own_names, written

PER_CLASS = (4000, 4000)
#: Standard errors taken off a term's log rate ratio, and the relevance that each unit above 0 adds.
CAUTION, RELEVANCE = 2.0, 2.0
BLOCK, NEIGHBOURS, COMMON = 64, 15, 32
#: Blocks that each query visits before the rest is held against its best so far, and queries that go together.
LEAD, TOGETHER = 16, 256
#: Words that are counted together.
WORDS = 1_000_000
#: More than the error of the common terms' sums, which are in single precision; cosines are not.
SLACK = 1e-5
PARTS = 3
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: the crc32 of its id as text is a multiple of FOLDS."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, stop), one range after the other."""
    sizes = stops - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


@dataclass(frozen=True)
class Rates:
    """Toxic rates: of texts without neighbours, and of those whose neighbours' share is `at`."""

    none: float
    at: np.ndarray
    rate: np.ndarray

    def of(self, share: float | None) -> float:
        if share is None:
            return self.none
        return float(np.interp(share, self.at, self.rate)) if len(self.at) else share


def calibrated(rows: list[tuple[int, float, float | None]]) -> Rates:
    """The rates of (label, weight, share) rows; the share is None where there are no neighbours."""
    known, alone = [r for r in sorted(rows, key=str) if r[2] is not None], [r for r in rows if r[2] is None]
    none = sum(y * w for y, w, _ in alone) / sum(w for _, w, _ in alone) if alone else 0.0
    label, weight, share = (np.array([r[k] for r in known], np.float64) for k in range(3))
    return Rates(none, *isotonic(share, label, weight))


class Index:
    """Block-max inverted index over unit vectors; the examples come as (terms, weights) with labels and ids."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, class_weights: np.ndarray, n_terms: int, fresh: list[bool]):
        edges = np.append(0, np.cumsum([len(t) for t, _ in vectors], dtype=np.int64))
        self._build(edges, *(np.concatenate([v[k] for v in vectors] or [np.zeros(0, np.int64)]) for k in (0, 1)), labels, ids, class_weights, n_terms, fresh)

    @classmethod
    def of(cls, edges: np.ndarray, term: np.ndarray, weight: np.ndarray, *rest) -> Index:
        """The same from all vectors in a row, of which `edges` tells the beginnings and the end."""
        own = cls.__new__(cls)
        own._build(edges, term, weight, *rest)
        return own

    def _build(self, edges: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, ids: list, class_weights: np.ndarray, n_terms: int, fresh) -> None:
        # Examples whose heaviest terms are the same share blocks, which keeps the bounds of other blocks low.
        sizes = np.diff(edges)
        heaviest = np.array([_heaviest(term[a:b], weight[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], np.int64)
        order = np.lexsort((sizes, heaviest))
        self.labels = labels[order]
        self.ids = [ids[i] for i in order.tolist()]
        self.place = {x: i for i, x in enumerate(self.ids)}
        self.vote = class_weights[self.labels]
        self.fresh = np.asarray(fresh, bool)[order]
        self.blocks = max(1, -(-len(sizes) // BLOCK))
        # The whole vectors, for exact cosines, and the common terms' weights as a matrix of terms by examples.
        spots = _ranges(edges[:-1][order], edges[1:][order])
        self.terms, self.weights, self.scratch = term[spots].astype(np.int32), weight[spots], np.zeros(n_terms)
        del spots, term, weight
        self.edges = np.append(0, np.cumsum(sizes[order], dtype=np.int64))
        example = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes[order])
        often = np.bincount(self.terms, minlength=n_terms) * COMMON > len(sizes)
        self.number = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        on = often[self.terms]
        self.common = np.zeros((int(often.sum()), self.blocks * BLOCK), np.float32)
        self.common[self.number[self.terms[on]], example[on]] = self.weights[on]
        # A cell is the part of a term's list that lies in one block; examples stand in order within it.
        rare = np.flatnonzero(~on).astype(np.int32)
        cell = self.terms[rare].astype(np.int64) * self.blocks + example[rare] // BLOCK
        by_cell = np.argsort(cell, kind="stable")
        cell, rare = cell[by_cell], rare[by_cell]
        del by_cell, on
        self.example, self.weight = example[rare], self.weights[rare]
        first = np.flatnonzero(np.diff(cell, prepend=-1)).astype(np.int32)
        self.first, self.last = first, np.append(first[1:], np.int32(len(cell))).astype(np.int32)
        self.block = (cell[first] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(cell[first] // self.blocks, np.arange(n_terms + 1)).astype(np.int32)

    def vector(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of an example."""
        a, b = int(self.edges[i]), int(self.edges[i + 1])
        return self.terms[a:b].astype(np.int64), self.weights[a:b]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, best first; `skip` is left out."""
        return next(self.nearest_of([(terms, weights)], k, [skip]))

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skips: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What `nearest` gives for each of the queries, which go through the index together."""
        m, width = len(queries), self.blocks * BLOCK
        owner = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, weights = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        number = self.number[terms]
        on = number >= 0
        dense = np.zeros((m, len(self.common)), np.float32)
        dense[owner[on], number[on]] = weights[on]
        scores = dense @ self.common
        owner, terms, weights = owner[~on], terms[~on], weights[~on]
        a, z = self.cells[terms], self.cells[terms + 1]
        own, times, owner = _ranges(a, z), np.repeat(weights, z - a), np.repeat(owner, z - a)
        spot = owner * self.blocks + self.block[own]
        bounds = scores.reshape(m, self.blocks, BLOCK).max(2) + np.bincount(spot, times * self.most[own], m * self.blocks).reshape(m, self.blocks) + SLACK
        scores[:, len(self.labels) :] = -2
        for i, skip in enumerate(skips):
            if skip >= 0:
                scores[i, skip] = -2
        cells = scores.reshape(-1, BLOCK)

        def visit(pairs: np.ndarray) -> np.ndarray:
            """The scores of the examples of the (query, block) pairs: the common terms' and now the rare ones' too."""
            slot = np.full(m * self.blocks, -1, np.int32)
            slot[pairs] = np.arange(len(pairs), dtype=np.int32)
            at = slot[spot]
            chosen = np.flatnonzero(at >= 0)
            lo, hi = self.first[own[chosen]], self.last[own[chosen]]
            rows = _ranges(lo, hi)
            places = np.repeat(at[chosen] * BLOCK, hi - lo) + self.example[rows] % BLOCK
            rare = np.bincount(places, self.weight[rows] * np.repeat(times[chosen], hi - lo), len(pairs) * BLOCK)
            return cells[pairs] + rare.reshape(-1, BLOCK).astype(np.float32)

        n = min(LEAD, self.blocks)
        lead = np.argpartition(-bounds, n - 1, 1)[:, :n] + np.arange(m)[:, None] * self.blocks
        seen = visit(lead.ravel()).reshape(m, -1)
        least = np.partition(seen, -k, 1)[:, -k] if seen.shape[1] >= k else np.full(m, -1.0)
        able = bounds >= np.maximum(least, 2 * SLACK)[:, None]
        able.ravel()[lead.ravel()] = False
        rest = np.flatnonzero(able)
        # What may be among the best: of the first blocks, and of the others by query.
        least = np.maximum(least - SLACK, 0)
        owner, at = np.nonzero(seen >= least[:, None])
        some, found = [seen[owner, at]], [(lead[owner, at // BLOCK] % self.blocks) * BLOCK + at % BLOCK]
        owners = [owner]
        if len(rest):
            more = visit(rest)
            pair, at = np.nonzero(more >= least[rest // self.blocks, None])
            some, found, owners = [*some, more[pair, at]], [*found, rest[pair] % self.blocks * BLOCK + at], [*owners, rest[pair] // self.blocks]
        some, found, owner = np.concatenate(some), np.concatenate(found), np.concatenate(owners)
        order = np.lexsort((found, owner))
        some, found, edges = some[order], found[order], np.searchsorted(owner[order], np.arange(m + 1)).tolist()
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            top, among = some[lo:hi], found[lo:hi]
            if len(top) > k:
                among = among[top >= np.partition(top, -k)[-k] - SLACK]
            yield self._exact(*queries[i], among, k)

    def _exact(self, terms: np.ndarray, weights: np.ndarray, able: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the examples `able`, by cosines of full precision."""
        if not len(able):
            return able, np.zeros(0)
        a, z = self.edges[able], self.edges[able + 1]
        parts = [slice(*ends) for ends in zip(a.tolist(), z.tolist(), strict=True)]
        self.scratch[terms] = weights
        each = self.scratch[np.concatenate([self.terms[part] for part in parts])]
        self.scratch[terms] = 0
        each *= np.concatenate([self.weights[part] for part in parts])
        sims = np.bincount(np.repeat(np.arange(len(able)), z - a), each, len(able))
        hit = sims > 0
        able, sims = able[hit], sims[hit]
        best = np.lexsort((able, -np.round(sims, 12)))[:k]
        return able[best], sims[best]

    def votes_of(self, queries: list[tuple[np.ndarray, np.ndarray]], skips: list[int]) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """(weighted share of toxic neighbours, the neighbours, their cosines) of each query; no share without neighbours."""
        for lo in range(0, len(queries), TOGETHER):
            for found, sims in self.nearest_of(queries[lo : lo + TOGETHER], NEIGHBOURS, skips[lo : lo + TOGETHER]):
                weight = sims * self.vote[found]
                yield (float((weight * self.labels[found]).sum() / weight.sum()) if len(found) else None), found, sims


def _heaviest(terms: np.ndarray, weights: np.ndarray) -> int:
    return int(terms[weights.argmax()]) if len(terms) else -1


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (places, rates) between which rates are interpolated."""
    pools: list[list[float]] = []  # weighted sum of y, weight, least x, greatest x
    for i in np.argsort(x, kind="stable").tolist():
        if pools and pools[-1][3] == x[i]:
            pools[-1][0] += w[i] * y[i]
            pools[-1][1] += w[i]
        else:
            pools.append([w[i] * y[i], w[i], x[i], x[i]])
    merged: list[list[float]] = []
    for pool in pools:
        merged.append(pool)
        while len(merged) > 1 and merged[-2][0] * merged[-1][1] >= merged[-1][0] * merged[-2][1]:
            last = merged.pop()
            merged[-1] = [merged[-1][0] + last[0], merged[-1][1] + last[1], merged[-1][2], last[3]]
    places = np.array([p for m in merged for p in (m[2], m[3])])
    return places, np.repeat([m[0] / m[1] for m in merged], 2)


# ---------------------------------------------------------------- learning and scoring


def _sample(docs: DataFrame, labels: DataFrame, id_col: str) -> tuple[DataFrame, np.ndarray]:
    """(the labelled sample: id, label; the weight of each class)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").cast("int").alias("label"))
    known = written(known, "labels")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64(id_col), id_col).limit(PER_CLASS[c]) for c in (0, 1)]
    weights = np.array([max(1.0, sizes.get(c, 0) / PER_CLASS[c]) for c in (0, 1)])
    return written(parts[0].union(parts[1]), "sample"), weights


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = set()
        for text in batch.column(0):
            found.update(_WORD.findall((text.as_py() or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["term"])


def _vectors(texts: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, tag, terms array<int>, counts array<int>) of each row."""
    known = texts.sparkSession.sparkContext.broadcast(zlib.compress("\n".join(terms).encode(), 1))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {t: i for i, t in enumerate(zlib.decompress(known.value).decode().split("\n"))}
        for batch in batches:
            done, said, sizes, held = 0, [], [], 0
            for i, text in enumerate(batch.column(2), 1):
                own = _WORD.findall((text.as_py() or "").lower())
                said.append(np.fromiter(map(names.get, own, repeat(-1)), np.int64, len(own)))
                sizes.append(len(own))
                held += len(own)
                if i == batch.num_rows or held > WORDS:
                    # Words of a text, by term: equal ones are counted.
                    owner, term = np.repeat(np.arange(i - done), sizes[done:]), np.concatenate(said)
                    cell, counts = np.unique((owner * (len(names) + 1) + term)[term >= 0], return_counts=True)
                    edges = np.searchsorted(cell, np.arange(i - done + 1) * (len(names) + 1))
                    lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (cell % (len(names) + 1), counts)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(done, i - done) for k in (0, 1)), *lists], ["id", "tag", "terms", "counts"])
                    done, said, held = i, [], 0

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, F.xxhash64(text_col).alias("tag"), text_col).mapInArrow(run, f"id {kind}, tag long, terms array<int>, counts array<int>")


def relevances(term: np.ndarray, label: np.ndarray, n_terms: int, sizes: np.ndarray) -> np.ndarray:
    """The relevance of each term, at least 1: `term` and `label` by posting, `sizes` the examples of both classes."""
    toxic, other = (np.bincount(term[label == c], minlength=n_terms) + 0.5 for c in (1, 0))
    ratio = np.log(toxic / (sizes[1] + 1) / (other / (sizes[0] + 1)))
    return 1 + RELEVANCE * np.maximum(ratio - CAUTION * np.sqrt(1 / toxic + 1 / other), 0)


def weigh(terms: np.ndarray, counts: np.ndarray, importance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights): (1 + ln tf) times the term's importance, as a unit vector."""
    t = np.asarray(terms, np.int64)
    w = (1 + np.log(np.asarray(counts, np.float64))) * importance[t]
    size = np.sqrt((w * w).sum())
    return t, w / size if size else w


def _held(sent: Broadcast) -> tuple[Index, np.ndarray]:
    """(the index, the importance of terms) that a broadcast stands for, made once for each worker."""
    if not hasattr(sent, "made"):
        edges, term, counts, label, ids, class_weights, importance, fresh = pickle.loads(zlib.decompress(sent.value))
        weight = (1 + np.log(counts)) * importance[term]
        sizes = np.sqrt(np.bincount(np.repeat(np.arange(len(label)), np.diff(edges)), weight * weight, len(label)))
        weight /= np.repeat(np.where(sizes > 0, sizes, 1), np.diff(edges))
        sent.made = Index.of(edges, term, weight, label, ids, class_weights, len(importance), fresh), importance
    return sent.made


def _lists(batch: pa.RecordBatch | pa.Table, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, terms, counts) of the list columns `at` and `at + 1`."""
    columns = [batch.column(k) for k in (at, at + 1)]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    edges = columns[0].offsets.to_numpy().astype(np.int64)
    return edges - edges[0], columns[0].flatten().to_numpy(zero_copy_only=False), columns[1].flatten().to_numpy(zero_copy_only=False)


def _rows(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    edges, terms, counts = _lists(batch, at)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield terms[a:b], counts[a:b]


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, held_out, score, predicted, evidence) for each row; `tag` is the text's xxhash64.

    `evidence` holds the three nearest examples: id, similarity, label.
    """
    return _scored(docs, labels, id_col, text_col)[0]


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(the scores, the scratch tables that are read for them)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sample, class_weights = _sample(docs, labels, id_col)
    chosen = sample.withColumnRenamed(id_col, "__id")
    named = docs.select(F.col(id_col).alias("id"), F.struct(F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text")).alias("own"))
    texts = named.join(F.broadcast(chosen), F.col("id") == F.col("__id")).groupBy("id", "label").agg(F.min("own").alias("own"))  # bounded by PER_CLASS
    texts = written(texts.select("id", "label", "own.tag", "own.text"), "examples")
    fresh = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS)) == 0
    vocabulary = sorted(texts.select("text").mapInArrow(_terms, "term string").distinct().toArrow().column(0).to_pylist())  # bounded by the sample
    table, n_terms = written(_vectors(docs, vocabulary, id_col, text_col), "vectors"), len(vocabulary)
    del vocabulary
    known = texts.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), "label")
    own = table.join(F.broadcast(known), (F.col("id") == F.col("__id")) & (F.col("tag") == F.col("__tag"))).dropDuplicates(["id"])  # bounded by PER_CLASS
    examples = own.select("id", "label", fresh.alias("fresh"), "terms", "counts").toArrow()
    examples = examples.take(pa.array(np.argsort(np.array([str(x) for x in examples.column(0).to_pylist()]), kind="stable")))
    edges, term, counts = _lists(examples, 3)
    label, new = examples.column(1).to_numpy().astype(np.int64), examples.column(2).to_numpy(zero_copy_only=False).astype(bool)
    n_docs, seen = table.count(), np.zeros(n_terms)
    found = table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow()  # bounded by the sample's terms
    seen[found.column(0).to_numpy()] = found.column(1).to_numpy()
    old = np.repeat(~new, np.diff(edges))
    sizes = np.bincount(label[~new], minlength=2)
    importance = np.log((1 + n_docs) / (1 + seen)) * relevances(term[old], np.repeat(label, np.diff(edges))[old], n_terms, sizes)
    state = (edges, term, counts, label, examples.column(0).to_pylist(), class_weights, importance, new)
    sent = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(state), 1))  # bounded as the sample is
    del state, examples, edges, term, counts, old

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _ = _held(sent)
        for batch in batches:
            own = [index.place[x] for x in batch.column(0).to_pylist()]
            got = [share for share, _, _ in index.votes_of([index.vector(i) for i in own], own)]
            yield pa.RecordBatch.from_arrays([pa.array(index.labels[own]), pa.array(index.vote[own]), pa.array(got, pa.float64())], ["label", "weight", "share"])

    pieces = 4 * spark.sparkContext.defaultParallelism
    tested = chosen.withColumnRenamed("__id", "id").where(fresh).join(texts.select("id"), "id", "left_semi")
    rates = calibrated([tuple(r) for r in tested.select("id").repartition(pieces, "id").mapInArrow(shares, "label long, weight double, share double").collect()])  # bounded by PER_CLASS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, importance = _held(sent)
        shape = pa.list_(pa.struct([("id", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            # Equal texts of a batch are looked up once.
            keys = [(index.place.get(x, -1), t.tobytes(), n.tobytes()) for x, (t, n) in zip(batch.column(0).to_pylist(), _rows(batch, 3), strict=True)]
            different = list(dict.fromkeys(keys))
            queries = [weigh(np.frombuffer(t, np.int32), np.frombuffer(n, np.int32), importance) for _, t, n in different]
            scored = {}
            for key, (share, found, sims) in zip(different, index.votes_of(queries, [own for own, _, _ in different]), strict=True):
                near = [{"id": str(index.ids[i]), "similarity": x, "toxic": int(index.labels[i])} for i, x in zip(found[:3].tolist(), sims[:3].tolist(), strict=True)]
                scored[key] = rates.of(share), near
            out, evidence = [scored[key][0] for key in keys], [scored[key][1] for key in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.float64()), pa.array(evidence, shape)], ["id", "tag", "held_out", "score", "evidence"])

    rows = table.select("id", "tag", held_out("id").alias("held_out"), "terms", "counts")
    if rows.rdd.getNumPartitions() < pieces:
        rows = rows.repartition(pieces, "id", "tag")
    scored = rows.mapInArrow(run, f"id {kind}, tag long, held_out boolean, score double, evidence array<struct<id:string,similarity:double,toxic:int>>")
    return scored.select(F.col("id").alias(id_col), "tag", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence"), [table, texts, sample]


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic."""
    found, scratch = _scored(docs.select(id_col, text_col), labels, id_col, text_col)
    # Written, so that the vectors of all texts are gone before the rows move, and don't stay beside later stages.
    toxic = written(found.where("predicted = 1").select(F.col(id_col).alias("__id"), F.col("tag").alias("__tag")).distinct(), "toxic")
    discard(*scratch)
    return _without(docs, toxic, id_col, text_col)


@own_names()
def _without(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose id and text are not in `found` (__id, __tag)."""
    return df.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__tag")), "left_anti")
