"""Importance resampling, the Merkle manifest and I-Match fingerprints, against brute force and their SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratiform.llm import imatch, merkle, registry, resampling
from tests import oracle
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_merkle_manifest", "op13_imatch"])
def test_queries_equal_their_sql(spark, name):
    oracle.check(registry.queries()[name](spark, SF), oracle.connect(SF).sql(registry.oracle_sql()[name]))


# ---------------------------------------------------------------- resampling


def _features(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)], len(words)


def _drawn(rows, target, order, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [_features(t, order) for _, t in rows]
    s, t = (Counter(bucket(f) for features in of for f in features) for of in ([f for f, _ in own], [_features(x, order)[0] for x in target]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for (d, _), (features, words) in zip(rows, own, strict=True):
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    enough = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4] >= least)
    ranks = {}
    for i, x in enumerate(enough[: percent * len(enough) // 100]):
        ranks.setdefault(x, []).append(i + 1)
    return Counter(r[:4] for r in out), sorted((k, v) for k, v in ranks.items())


@pytest.mark.parametrize("order,buckets,least,percent", [(1, 10_000, 20, 10), (3, 64, 1, 50), (2, 1000, 0, 100)])
def test_resampling_matches_brute_force(spark, order, buckets, least, percent):
    target = ["alpha beta gamma word for word", None, "é😀 ü", "w1 w2 w3 w4"]
    got = resampling.resample(cases.table(spark), spark.createDataFrame([(t,) for t in target], "text string"), order, buckets, 2024, least, percent).collect()
    rows, ranks = _drawn([(r[0], r[1]) for r in cases.rows()], target, order, buckets, least, percent)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == rows
    mine = {}
    for r in got:
        if r["rank"] is not None:
            mine.setdefault((-r["score"], r["doc_id"] is None, r["doc_id"] or 0), []).append(r["rank"])
    assert sorted((k, sorted(v)) for k, v in mine.items()) == ranks


def test_resampling_prefers_the_target(spark):
    rows = [(i, "sun moon star " * 10 if i % 2 else "iron coal salt " * 10) for i in range(400)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("moon and star " * 99,)], "text string"), buckets=100)
    drawn = [r["doc_id"] % 2 for r in got.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 40 and sum(drawn) > 30


def test_resampling_of_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 7)
    text = "aa bb CC dd,ee ff gg " * 50
    assert resampling.features(text, 3) == (Counter(f.encode() for f in _features(text, 3)[0]), 350)
    empty = cases.empty(spark)
    assert resampling.resample(empty, empty).count() == 0 and resampling.resample(cases.table(spark), empty, percent=100).where("rank IS NOT NULL").count() > 0


def test_a_bucket_in_every_document_is_spread(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    own = resampling.postings(df, 1, 10, "doc_id", "text", "p")
    assert own.where("bucket IS NOT NULL").agg(F.max(F.size("docs"))).first()[0] <= 4000 / spark.sparkContext.defaultParallelism + 1
    assert resampling.resample(df, df, least_words=1).where("rank IS NOT NULL").count() == 400


# ---------------------------------------------------------------- manifest


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _tree(hashes, fanout=8):
    """(root, the siblings of each leaf level by level)."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, i in enumerate(at):
            lo = i - i % fanout
            paths[leaf].append((hashes[lo:i], hashes[i + 1 : lo + fanout]))
        hashes = [_sha("".join(hashes[i : i + fanout])) for i in range(0, len(hashes), fanout)]
        at = [i // fanout for i in at]
    return hashes[0], paths


def _leaf(row):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest_matches_brute_force(spark, fanout):
    groups = ([None] * 3 + ["en"] * 70 + ["de"] + ["É"] * 8 + ["z"] * 9 + [""] * 65)[:156]
    rows = [(None if i % 50 == 7 else i // 2 * 7 % 90, None if i % 5 == 0 else f"t{i // 3}", g, i % 4) for i, g in enumerate(groups)] + [(1, "twin", "en", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").repartition(5)
    got = merkle.manifest(df, ("doc_id", "lang", "n", "text"), fanout=fanout, extra={"bad": F.lit("x")}).collect()
    by = {}
    for d, t, g, n in rows:
        by.setdefault(g, []).append((d is not None, d or 0, _leaf((d, g, n, t))))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(by[g])], fanout) for g in order}
    root, above = _tree([trees[g][0] for g in order], fanout)
    want = Counter()
    for g, up in zip(order, above, strict=True):
        for (_, _, leaf), path in zip(sorted(by[g]), trees[g][1], strict=True):
            want[leaf, trees[g][0], root, tuple(("".join(a), "".join(b)) for a, b in path + up), "x"] += 1
    assert Counter((r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"])), r["bad"]) for r in got) == want


def test_manifest_finds_tampering(spark):
    df = spark.createDataFrame([(i, "Text" if i % 2 else "text", "en", "s", 4) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in merkle.digests(df).collect()}
    assert all(r["verified"] == (not (d % 2 and zlib.crc32(str(d).encode()) % 3 == 0)) == (r["folded_root"] == r["root"]) for d, r in got.items())
    assert len({r["root"] for r in got.values()}) == 1 and len({r["proof_sha256"] for r in got.values()}) == 100
    one = merkle.digests(df.limit(1)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == _sha("")
    assert merkle.digests(cases.empty(spark)).count() == 0 and merkle.digests(cases.table(spark)).count() == len(cases.rows())


# ---------------------------------------------------------------- fingerprints


def _prints(texts, least=imatch.LEAST, most=imatch.MOST):
    """A function from texts to fingerprints, by the lexicon of `texts`."""
    terms = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if w}
    df = Counter(w for t in texts for w in terms(t))
    words = {w: hashlib.sha256(w.encode()).hexdigest() for w, n in df.items() if n * least <= len(texts) <= n * most}

    def make(text):
        own = sorted((int(words[w][:15], 16), words[w]) for w in terms(text) & set(words))
        if not own:
            return hashlib.md5(text.encode()).hexdigest()[:8] * 16
        sets = [own]
        for r in range(15):
            depth = lambda x, r=r: min(15, 16 - int(x[1][4 * r + 4 : 4 * r + 8], 16).bit_length())
            sets.append([x for x in own if depth(x) == max(map(depth, own))])
        return "".join(hashlib.md5(" ".join(str(c) for c, _ in s).encode()).hexdigest()[:8] for s in sets)

    return make


def _alike(a, b):
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 128, 8)) / 16


@pytest.mark.parametrize("chunk", [2, 64])
def test_fingerprints_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(imatch, "CHUNK_ROWS", chunk)
    own = [(r[0], r[1]) for r in cases.rows()] + [(1000 + i * i, f"word{i % 3} other{i % 7} thing{i} more{i % 11} and {i}") for i in range(60)] + [(-(10**15), "Word1 OTHER2 far away"), (10**15, None)]
    rows = [(d, t or "") for d, t in own]
    texts = [t for _, t in sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(4)
    make = _prints([t for _, t in rows])
    got = imatch.digests(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    # Ids that stand once, whose next has an id, have one next text.
    once = [d for d, n in Counter(d for d, _ in rows).items() if n == 1 and d is not None]
    ids = sorted((d for d, _ in rows if d is not None), reverse=True)
    for d in once:
        r, at = by_id[d][0], ids.index(d)
        text = texts[at]
        assert r["n_chars"] == len(text) and r["fingerprint"] == make(text), d
        if at + 1 == len(ids):
            continue
        cut = len(text) // 3
        edited = text[: len(text) - cut] + texts[at + 1][:cut]
        assert r["edited_sha256"] == _sha(edited) and r["edited_fingerprint"] == make(edited)
        assert (r["near_edited"], r["near_next"]) == (_alike(make(text), make(edited)), _alike(make(text), make(texts[at + 1])))
    # The rows without an id come last, in the order of their texts' hashes; the first follows the last of them.
    bare = spark.createDataFrame([(t,) for d, t in rows if d is None], "t string").orderBy(F.xxhash64("t")).collect()
    last = next(r for r in by_id[None] if r["fingerprint"] == make(bare[-1][0]))
    assert last["near_next"] == _alike(make(bare[-1][0]), make(texts[0]))
    assert len({r["fingerprint"] for r in by_id[6]}) == 1


def test_fingerprints_of_one_row_none_and_other_ids(spark):
    one = imatch.digests(spark.createDataFrame([(5, "Ein Text")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == _sha("Ein Te" + "Ei")
    assert imatch.digests(cases.empty(spark)).count() == 0
    assert imatch.digests(spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")).count() == 2
    with pytest.raises(TypeError):
        imatch.digests(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_fingerprints_stay_in_the_jvm_and_move_texts_once(spark):
    plan = imatch.digests(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("Exchange hashpartitioning") == 1
