"""Toxicity, URL filters and quality rules."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratiform.llm import quality, registry, toxicity, urls
from tests import oracle
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_nearest_examples_equal_brute_force():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = toxicity.Index(vectors, rng.integers(0, 2, 500), list(range(500)), np.ones(2), 40, [True] * 500)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(map(index.vector, range(len(index.labels)))):
        dense[i, t] = w
    for t, w in vectors[:100]:
        found, sims = index.nearest(t, w, 7)
        all_sims = dense[:, t] @ w
        best = np.lexsort((np.arange(500), -np.round(all_sims, 12)))[:7]
        best = best[all_sims[best] > 0]
        assert found.tolist() == best.tolist() and np.allclose(sims, all_sims[best])


def test_nearest_examples_by_rare_and_common_terms_equal_brute_force():
    rng = np.random.default_rng(9)
    chances = 1 / np.arange(1, 3001)
    vectors = []
    for _ in range(900):
        t = np.unique(rng.choice(3000, rng.integers(1, 60), p=chances / chances.sum()))
        w = rng.random(len(t)) * np.log(t + 2)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.Index(vectors[:800], rng.integers(0, 2, 800), list(range(800)), np.ones(2), 3000, [True] * 800)
    assert len(index.weight) > 1000 and (index.common > 0).sum() > 1000
    dense = np.zeros((800, 3000))
    for i, (t, w) in enumerate(map(index.vector, range(len(index.labels)))):
        dense[i, t] = w
    for j, (t, w) in enumerate(vectors[700:]):
        skip = j % 3 * 5 - 1
        found, sims = index.nearest(t, w, 15, skip)
        want = dense[:, t] @ w
        if skip >= 0:
            want[skip] = 0
        best = np.lexsort((np.arange(800), -np.round(want, 12)))[:15]
        best = best[want[best] > 0]
        assert found.tolist() == best.tolist() and np.allclose(sims, want[best])


def test_an_example_of_words_that_no_other_has_is_not_its_own_neighbour():
    vectors = [(np.array([i]), np.ones(1)) for i in range(100)]
    index = toxicity.Index(vectors, np.arange(100) % 2, list(range(100)), np.ones(2), 100, [True] * 100)
    for skip in range(100):
        found, _ = index.nearest(*vectors[index.ids[skip]], 3, skip)
        assert not len(found)


def test_isotonic_rates_rise():
    x, rate = toxicity.isotonic(np.array([0.0, 0.1, 0.1, 0.5, 0.9]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]), np.ones(5))
    assert (np.diff(rate) >= 0).all() and rate[0] == 0 and rate[-1] == 1 and len(x) == len(rate)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op3_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit / sum(r["toxic"] for r in got) > 0.9 and hit / sum(r["predicted"] for r in got) > 0.9
    brier = sum((r["score"] - r["toxic"]) ** 2 for r in got) / len(got)
    assert brier < 0.05 and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_on_awkward_rows(spark):
    docs = cases.table(spark)
    labels = spark.createDataFrame([(i, i % 2, int(i in (20,))) for i in range(1, 30)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.scores(docs, labels).count() == docs.count()
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert {r["score"] for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.keep_clean(cases.empty(spark), labels).count() == 0


def reference(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [h + p for h, p, _ in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    odd = [None, "", "x", "http://NET/", "https://a.EXAMPLE.net/en/", "a://b://c/", "http://net?x", "http://x.org/fr", "http://x.org/fr/\n?", "http://\nnet/", "http://example.com/de/#/", "://net/", "http://ÉXAMPLE.net/"]
    known = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(None if i == 3 else i, u, "clash", "clash") for i, u in enumerate(odd + known + ["http://net/"] * 2)], "page_id long, url string, host string, score string")
    got = urls.judge(df).collect()
    assert len(got) == df.count()
    by_id = {r["page_id"]: r for r in got}
    for i, url in enumerate(odd + known):
        if i != 3:
            assert tuple(by_id[i][c] for c in ("host", "path", "rule")) == reference(url), url
    verdicts = {h + p: v for h, p, v in urls.RULES}
    assert all(r["verdict"] == verdicts[r["rule"]] for r in got if r["rule"])
    assert urls.judge(df.limit(0)).count() == 0


def _area(scores, labels):
    """The chance that a blocked URL has a higher score than an allowed one; ties count half."""
    pos, neg = ([x for x, y in zip(scores, labels, strict=True) if y == k] for k in (1, 0))
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def test_url_model_on_hosts_that_it_has_not_seen(spark):
    pages = urls.parsed(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is not null")
    verdicts = {h + p: v for h, p, v in urls.RULES}
    labelled = pages.withColumn("blocked", F.col("rule").isin([r for r, v in verdicts.items() if v == "block"]).cast("int"))
    held = F.pmod(F.xxhash64("host"), F.lit(4)) == 0
    model = urls.train(labelled.where(~held))
    got = urls.scored(labelled.where(held), model).collect()
    assert len(got) > 100 and _area([r["score"] for r in got], [verdicts[r["rule"]] == "block" for r in got]) > 0.8


def test_url_features():
    url = ["https://www.Ex-a.example.org/de/p1//x.html?a=1&b=2#top", "", "http://h/"]
    host, path, query = ["www.ex-a.example.org", "", "h"], ["/de/p1//x.html", "", "/"], ["a=1&b=2", "", ""]
    got = urls.features(*(pa.array(x) for x in (url, host, path, query)))
    entropy = lambda t: -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))
    u = url[0]
    want = [len(u), 20, 14, 7, 4, 7, 3, 6, 3 / len(u), sum(c.isalpha() for c in u) / len(u), 1 / len(u), 1, 0, 0, entropy(host[0]), entropy(path[0]), 2, 1, 1]
    assert np.allclose(got[0], want) and not got[1].any()
    assert np.allclose(got[2], [9, 1, 1, 0, 1, 1, 0, 0, 0, 5 / 9, 0, 0, 0, 0, 0, 0, 0, 0, 0])


def test_suffix_statistics_cover_all_and_leave_the_own_host_out(spark):
    rows = [(i, f"http://h{i % 7}.s{i}.t{i % 3}/p{i}.e{i % 5}") for i in range(60)]
    known = urls.parsed(spark.createDataFrame(rows, "page_id long, url string")).withColumn("blocked", (F.col("id") % 2).cast("int"))
    model = urls.train(known)
    got = {r["key"]: (r["total"], r["hosts"]) for kind in model.suffixes.values() for r in kind.collect()}
    assert got["1:t0"] == (10, 20) and got["2:s5.t2"] == (1, 1) and got["e:e3"] == (6, 12) and len(got) == 3 + 60 + 5 + 60
    assert model.base == 0.5 and {r["blocked"] for r in known.collect()} == {0, 1}


def test_url_models_of_one_class_or_none(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.io/"), (3, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()} == {1: "block", 2: "block", 3: "block"}
    assert {r["verdict"] for r in urls.judge(df.where("page_id > 1")).collect()} == {"allow"}


def test_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.4) ^ (x[:, 2] > 0.7)).astype(float)
    model = urls.fit(x[:2000], y[:2000])
    assert ((model.rate(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_quality_matches_the_oracle(spark):
    sf = "/root/testdata/sf0.001"
    oracle.check(registry.op7_quality_rules(spark, sf), oracle.connect(sf).sql(quality.ORACLE_SQL))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_on_awkward_rows(spark):
    df = cases.table(spark)
    got = quality.judge(df).collect()
    assert len(got) == df.count() and quality.judge(cases.empty(spark)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in got:
        if r["doc_id"] is None:
            continue
        own, seen, covered, lines = words(texts[r["doc_id"]]), {}, set(), []
        for i in range(len(own) - 7):
            seen.setdefault(tuple(own[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                covered |= {i + k for i in at for k in range(8)}
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if words(x)]
        want = (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", texts[r["doc_id"]] or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, r
        assert r["base_failed"] == (len(own) < 20 or 100 * len(covered) > 30 * len(own))
        assert not (r["base_failed"] and r["kept"])


def test_cascade_order_does_not_change_verdicts(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {tuple(r) for r in quality.judge(df).collect()}
    monkeypatch.setattr(quality, "ordered", lambda *_: quality.rules()[::-1])
    assert {tuple(r) for r in quality.judge(df).collect()} == want


def test_scores_equal_brute_force(spark, monkeypatch):
    """Every score and its evidence, from the definition: cosines with all examples, votes, and the isotonic fit."""
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = np.random.default_rng(8)
    names = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    bad = ["scum", "moron"]
    rows = []
    for i in range(240):
        own = [names[int(k)] for k in rng.integers(0, 100, rng.integers(1, 30))]
        if i % 3 == 0:
            own += [bad[int(k)] for k in rng.integers(0, 2, 2)]
        rows.append((i, " ".join(own)))
    rows += [(240, None), (241, rows[7][1]), (242, "zzz"), (None, rows[3][1])]
    labels = [(i, 0, int(i % 3 == 0)) for i in range(0, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select("doc_id", "score", "evidence").collect()

    fresh = {r[0] for r in spark.createDataFrame([(d,) for d, _, _ in labels], "id long").where("pmod(xxhash64(id, 'part'), 3) = 0").collect()}
    want = cases.toxic_scores(rows, {d: t for d, _, t in labels}, fresh)
    assert len(got) == len(rows)
    for r in got:
        score, best = want[r["doc_id"]]
        assert abs(r["score"] - score) < 1e-9, (r, score)
        assert np.allclose([e["similarity"] for e in r["evidence"]], [s for _, s in best[:3]])
        assert str(r["doc_id"]) not in {e["id"] for e in r["evidence"]}
