"""Line, suffix-array and SimHash dedup against brute force, on awkward rows and on real tables."""

import os
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stratiform.llm import common, graph, lines, registry, shingles, simhash, suffixes
from tests import oracle
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("hot", [256, 1])
def test_suffixes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_PHRASES", hot)
    random.seed(7)
    words = ["aa", "ab", "ba", "bb", "abc"]
    noise = [(i, " ".join(random.choices(words, k=random.randint(0, 80)))) for i in range(60)]
    for df in (cases.table(spark).where("doc_id is null or doc_id < 12 or doc_id > 13"), spark.createDataFrame(noise, "doc_id long, text string").repartition(4)):
        got = Counter(map(tuple, suffixes.digests(df).collect()))
        assert got == Counter(cases.kept_bytes(pairs(df)))


def test_suffix_ids(spark):
    text = "a passage of well over fifty bytes that stands in all of these rows"
    df = spark.createDataFrame([(2**63 - 1, text), (None, text), (7, text)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in suffixes.digests(df).collect()} == {(2**63 - 1, len(text)), (None, len(text)), (7, 0)}
    with pytest.raises(TypeError, match="doc_id"):
        suffixes.digests(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_suffixes_of_a_long_text(spark):
    rng = random.Random(3)
    body = "".join(rng.choices("abcdefgh ", k=3_000_000))
    rows = {1: "x" + body[1_000_000:1_000_200], 2: body, 3: body[500_000:2_500_000]}
    got = suffixes.digests(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == {1: (201, 0, 0), 2: (3_000_000, 200, 1), 3: (2_000_000, 2_000_000, 1)}


def _surrounded(rng, middles):
    """The middles, each between random letters of its own."""
    letters = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(40, 90)))
    return "".join(letters() + x for x in middles) + letters()


def test_suffixes_send_no_bytes_for_a_trigger_alone(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(suffixes, "written", lambda df, name: tables.setdefault(name, common.written(df, name)))
    rng = random.Random(5)
    grams = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=16)) for _ in range(40)]
    df = spark.createDataFrame([(i, _surrounded(rng, grams)) for i in range(20)], "doc_id long, text string").repartition(4)
    assert {r["n_removed"] for r in suffixes.digests(df).collect()} == {0}
    assert tables["parse"].count() == 0
    # Ids of one row each need no hash of the text beside every span.
    twice = df.union(df.withColumn("doc_id", F.col("doc_id") + 20))
    for both, several in ((twice, False), (twice.union(twice.where("doc_id = 25")), True)):
        tables.clear()
        assert Counter(map(tuple, suffixes.digests(both).collect())) == Counter(cases.kept_bytes(pairs(both)))
        assert (tables["parse"].where("tag <> 0").count() > 0) == several


def test_suffixes_meet_wherever_their_trigger_stands(spark):
    rng = random.Random(11)
    passages = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=50)) for _ in range(400)]
    rows = [(i, _surrounded(rng, passages[i % 20 :: 20])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in suffixes.digests(df).collect()}
    assert all(got[i]["n_spans"] == (20 if i >= 20 else 0) and got[i]["n_removed"] >= 50 * got[i]["n_spans"] for i in range(60))
    assert Counter(tuple(r) for r in got.values()) == Counter(cases.kept_bytes(rows))


def test_suffix_dedup_keeps_rows_and_columns(spark):
    df = cases.table(spark)
    out = suffixes.dedup(df)
    assert out.columns == df.columns and out.count() == df.count()
    kept = {r["id"]: r for r in out.collect()}
    assert kept[2]["text"] is None and kept[5]["text"] == kept[6]["text"] and len(kept[5]["text"]) < 50 and kept[0]["text"].endswith(" one")
    assert suffixes.dedup(cases.empty(spark)).count() == 0 and suffixes.digests(cases.empty(spark)).count() == 0


def test_lines_match_the_oracle(spark):
    oracle.check(registry.op4_winnowing(spark, SF), oracle.connect(SF).sql(lines.ORACLE_SQL))


def test_lines_on_awkward_rows(spark):
    df = cases.table(spark)
    out = {r["id"]: r["text"] for r in lines.dedup(df).collect()}
    assert len(out) == df.count() and out[2] is None
    assert out[7] == "first line here\nsecond line there\nthird line elsewhere\nfourth line"
    assert out[8] == "x\ny" and out[9] == ""
    assert lines.dedup(cases.empty(spark)).count() == 0


def _line_runs(pairs):
    """{(id, text): kept text} from the definition: every window against all earlier places."""
    order = lambda d: (d is None, d or 0)
    texts = sorted({(d, t) for d, t in pairs}, key=lambda x: (order(x[0]), xxhash64(x[1])))
    seen, out = set(), {}
    for d, t in texts:
        own = [line.strip(" \t\n\x0b\f\r") for line in (t or "").split("\n")]
        gone = set()
        for i in range(len(own)):
            for k in (1, 2, 3):
                window = tuple(own[i : i + k])
                if len(window) == k and sum(len(x.encode()) for x in window) >= (1 if k == 3 else 50):
                    if window in seen:
                        gone |= set(range(i, i + k))
                    seen.add(window)
        out[d, t] = t if not gone else "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)
    return out


def xxhash64(text):
    """Spark's signed hash of a text; 42 for null."""
    x = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
    return x - (x >> 63 << 64)


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    short, long_ = ["a", "b", "", "c c", "  "], ["one line that is long enough to count by itself, " + x for x in "xy"] + ["thirty bytes or so of a line " + x for x in "uv"]
    texts = [(rng.randrange(90) or None, "\n".join(rng.choice(short if rng.random() < 0.6 else long_) for _ in range(rng.randrange(1, 12)))) for _ in range(150)]
    for df in (spark.createDataFrame(texts, "doc_id long, text string").repartition(4), cases.table(spark).where("doc_id is null or doc_id not in (12, 13)")):
        want = _line_runs(pairs(df))
        assert Counter(pairs(lines.dedup(df))) == Counter((d, want[d, t]) for d, t in pairs(df))
    named = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert lines.dedup(named).count() == df.count()


def test_lines_of_a_long_text(spark):
    body = "\n".join(f"line {i % 70_000} of a text of several megabytes" for i in range(100_000))
    got = lines.digests(spark.createDataFrame([(1, body), (2, body)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got} == {1: (100_000, 30_000), 2: (100_000, 100_000)}


def test_winnowing_never_misses_a_run():
    rng = np.random.default_rng(1)
    for _ in range(200):
        run = rng.integers(0, 5, 3).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 5, rng.integers(0, 6)).astype(np.uint64), run, rng.integers(0, 5, rng.integers(0, 6)).astype(np.uint64)]) for _ in range(2))
        common = {tuple(x) for x in np.lib.stride_tricks.sliding_window_view(a, 3)} & {tuple(x) for x in np.lib.stride_tricks.sliding_window_view(b, 3)}
        for window in common:
            at = [[int(p) - i for i, p in enumerate(lines.winnow(x, 3)) if tuple(x[i : i + 3]) == window] for x in (a, b)]
            assert set(at[0]) == set(at[1])


def test_line_dedup_leaves_only_the_matches_when_texts_are_dealt(spark):
    """Of its scratch tables those that are read no more are gone before the texts move."""
    before = set(common._TABLES)
    lines.repeats(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(set(common._TABLES) - before) == 1


def test_pipeline_stages_leave_no_table_of_all_texts_behind(spark):
    """What a stage's result still reads is small: vectors, shingles and marks of all texts are gone before the next stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = set(common._TABLES)
        rows = stage(spark, docs, SF).count()
        left = {os.listdir(folder.removeprefix("file:"))[0] for folder in set(common._TABLES) - before}
        assert rows and not left & {"vectors", "examples", "sets", "marks", "different", "fingerprints", "windows"}, (name, left)


def test_simhash_matches_brute_force(spark):
    for df in (cases.table(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        prints = [(d, cases.fingerprint(t)) for d, t in pairs(df)]
        want = Counter((d, f, c) for (d, f), (_, c) in zip(prints, cases.components(prints), strict=True))
        assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()) == want


def test_simhash_keeps_one_of_each_group(spark):
    kept = [r["doc_id"] for r in simhash.dedup(cases.table(spark)).collect()]
    assert 1 in kept and 18 in kept and 19 not in kept and 12 in kept and 13 not in kept and 3 in kept and None not in kept
    assert simhash.dedup(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("dedup", [simhash.dedup, shingles.dedup])
def test_one_row_of_each_group_stays_whatever_the_ids(spark, dedup):
    a, b = ("one text of quite a few words that is here again and again", "and another text that only one of the rows has got, and no more")
    rows = [(1, a), (5, a), (5, b), (1, a), (None, a), (None, "a third text of which the row has no id at all, and none like it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(pairs(dedup(df)), key=str) == [(1, a), (5, b), rows[5]]


def test_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    near = [x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for x in base for k in (1, 3, 4, 5, 7)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    keys = simhash.cells(simhash.embedding(fps))
    u, v = simhash.links_of(keys.ravel(), np.repeat(fps, keys.shape[1]))
    assert (np.bitwise_count(u ^ v) <= 4).all()
    ids = {int(f): i for i, f in enumerate(fps)}
    want = {i: c for i, c in cases.components([(i, int(f)) for f, i in ids.items()])}
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = sorted((root(ids[a]), root(ids[b])))
        parent[y] = x
    assert {i: root(i) for i in want} == want


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain + star + [(5, 5)], "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1100)} == {1000}


def _similar(pairs):
    """{id: least id of its component} at a five-word Jaccard similarity of 0.8 or more, pair by pair."""
    sets = []
    for d, t in pairs:
        words = (t or "").lower().split()
        sets.append((d, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}))
    least = {d: d for d, _ in sets}
    changed = True
    near = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if 5 * len(x & y) >= 4 * len(x | y)]
    while changed:
        changed = False
        for a, b in near:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def _near_texts():
    rng = random.Random(5)
    out = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 30, 120, 600]))]
        out.append(words)
        # Changed words take up to five shingles each: similarities on both sides of 0.8, and chains of copies of copies.
        for _ in range(3):
            words = list(words)
            for k in rng.sample(range(len(words)), max(1, len(words) * rng.choice([1, 2, 3, 5]) // 100)):
                words[k] = f"x{rng.randrange(5000)}"
            out.append(words)
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_near_copies_match_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (documents, spark.createDataFrame(_near_texts(), "doc_id long, text string").repartition(4)):
        want = _similar(pairs(df))
        assert len(set(want.values())) < len(want)
        assert {r["doc_id"]: r["component_id"] for r in shingles.near_copies(df).collect()} == want


def test_near_copies_that_all_share_one_key(spark, monkeypatch):
    """However many sets a key has, similar or not, no link of them is missed."""
    monkeypatch.setattr(shingles, "bands", lambda own: np.array([7] if len(own) else [], np.int64))
    monkeypatch.setattr(shingles, "BLOCK", 16)
    df = spark.createDataFrame(_near_texts(), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_copies(df).collect()} == _similar(pairs(df))


def test_pipeline_joins_near_copies_by_simhash(spark, monkeypatch):
    """Without any min-wise key the grid of fingerprints still joins all within 4 bits, and only what is similar."""
    monkeypatch.setattr(shingles, "bands", lambda own: np.zeros(0, np.int64))
    texts = _near_texts()
    prints = {d: shingles.fingerprint(shingles.shingles(t)) for d, t in texts}
    whole = _similar(texts)
    sets = {d: set(shingles.shingles(t).tolist()) for d, t in texts}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert near
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(df).collect()}
    assert all(got[a] == got[b] for a, b in near) and len(got) - len(set(got.values())) > len(near) and all(whole[d] == whole[c] for d, c in got.items())
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()} == set(got.values())


def test_pipeline_drops_texts_that_share_four_fifths_of_their_shingles(spark):
    words = [f"w{i}" for i in range(204)]
    texts = [words, [*words[:50], "x", *words[51:120], "y", *words[121:]], [w if i % 20 else f"z{i}" for i, w in enumerate(words)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()) == [0, 2]


def test_near_copies_on_awkward_rows(spark):
    df = cases.table(spark)
    kept = shingles.dedup(df)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and None not in ids and 3 in ids and 4 not in ids and 5 not in ids and 18 in ids and 19 not in ids
    assert 12 in ids and 13 not in ids and 1 in ids and 2 not in ids and 6 not in ids
    assert shingles.dedup(cases.empty(spark)).count() == 0
