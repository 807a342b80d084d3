"""Packing, sharding, BPE, FLAC and the pipeline."""

import hashlib
import itertools
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from stratiform.llm import bpe, common, flac, packing, sharding
from tests.llm import cases, flac_writer, test_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(20))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
    counts = [rng.randint(1, 9) for _ in lengths]
    buckets = rng.randint(1, 4)

    def padding(tops):
        return sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts, strict=True))

    best = min(padding(c + (lengths[-1],)) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k))
    tops = packing.boundaries(counts, [c * x for c, x in zip(counts, lengths, strict=True)], lengths, buckets)
    assert len(tops) <= buckets and padding(tuple(tops)) == best


def test_boundaries_over_thousands_of_lengths_are_optimal():
    rng = np.random.default_rng(6)
    lengths = np.sort(rng.choice(30_000, 5000, replace=False) + 1)
    counts = rng.integers(1, 50, len(lengths))
    n_before, s_before = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * lengths))
    best = np.concatenate([[0], np.full(len(lengths), 2**60)])
    for _ in range(8):
        layer = best.copy()
        for i in range(1, len(lengths) + 1):
            layer[i] = (best[:i] + lengths[i - 1] * (n_before[i] - n_before[:i]) - (s_before[i] - s_before[:i])).min()
        best = layer
    tops = np.array(packing.boundaries(counts.tolist(), (counts * lengths).tolist(), lengths.tolist(), 8))
    assert (counts * (tops[np.searchsorted(tops, lengths)] - lengths)).sum() == best[-1]


def test_packing_matches_brute_force(spark):
    """The whole result: buckets of least padding, budgets, and places by (chunk, id, hash) within each bucket."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lengths = {r["doc_id"]: len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w]) for r in df.collect()}
    got = {r["doc_id"]: r for r in packing.pack(df, buckets=3).collect()}
    each = sorted(set(lengths.values()))
    pad = lambda tops: sum(min(t for t in tops if t >= x) - x for x in lengths.values())
    best = min(pad((*c, each[-1])) for c in itertools.combinations(each[:-1], 2))
    assert sum(r["padded_tokens"] - r["n_tokens"] for r in got.values()) == best
    tops = sorted({r["padded_tokens"] for r in got.values()})
    for d, x in lengths.items():
        assert (got[d]["n_tokens"], got[d]["padded_tokens"], got[d]["bucket"]) == (x, min(t for t in tops if t >= x), sum(t < x for t in tops))
    for k, top in enumerate(tops):
        own = [(r["batch"], r["slot"]) for r in got.values() if r["bucket"] == k]
        per = max(1, packing.BATCH_TOKENS // max(top, 1))
        assert sorted(own) == [(i // per, i % per) for i in range(len(own))]


def test_packing_places_every_row_once(spark):
    for df in (cases.table(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = packing.pack(df).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.collect())
        batches = defaultdict(list)
        for r in got:
            assert r["n_tokens"] <= r["padded_tokens"]
            batches[r["bucket"], r["batch"]].append(r)
        for own in batches.values():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
            assert len(own) == 1 or len(own) * own[0]["padded_tokens"] <= packing.BATCH_TOKENS
    assert packing.pack(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_minimax_capacity_is_least(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
    shards = rng.randint(1, 4)
    cuts = [(0, *c, len(sizes)) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1)]
    best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise(c)) for c in cuts)
    capacity, ends = sharding.minimax(sizes, shards)
    assert capacity == best and len(ends) == shards and ends[-1] == len(sizes)
    assert max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *ends])) <= capacity


@pytest.mark.parametrize("seed", range(4))
def test_refined_ranges_give_the_least_capacity_over_groups(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "CELL_BITS", 4)
    monkeypatch.setattr(sharding, "SPLIT_BITS", 2)
    rng = np.random.default_rng(seed)
    hashes = np.unique(rng.integers(-(2**63), 2**63, 400))
    if seed % 2:  # hashes that only their last bits tell apart
        hashes = np.unique(np.concatenate([hashes[:50], hashes[7] + np.arange(200)]))
    sizes = rng.integers(1, 1000, len(hashes))
    if seed >= 2:
        sizes[len(sizes) // 3] = sizes.sum() // 2
    groups = spark.createDataFrame(list(zip(hashes.tolist(), sizes.tolist(), strict=True)), "hash long, bytes long")
    capacity, firsts = sharding.cuts_of(groups, 7)
    assert capacity == sharding.minimax(sizes, 7)[0]
    at = [0, *np.searchsorted(hashes, firsts).tolist(), len(hashes)]
    assert at == sorted(at) and max(int(sizes[a:b].sum()) for a, b in itertools.pairwise(at)) <= capacity


def test_shards_match_brute_force(spark):
    """Sizes, checksums and shards of all rows against the definition over whole groups; slots are gapless."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    rows = sorted(df.collect(), key=lambda r: r["h"])
    order = [list(own) for _, own in itertools.groupby(rows, key=lambda r: r["h"])]
    sizes = [sum(len((r["text"] or "").encode()) + 1 for r in own) for own in order]
    _, cuts = sharding.minimax(sizes, 16)
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), sum(i >= c for c in cuts)) for i, own in enumerate(order) for r in own}
    got = sharding.shard(df.drop("h")).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"]) for r in got} == want and len(got) == len(rows)
    for k in range(16):
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own)))


def test_tables_need_a_shared_folder_and_can_be_released(spark, monkeypatch):
    kept = common.written(spark.range(3), "kept")
    common.release(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        kept.collect()

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def test_shards_keep_equal_texts_together(spark):
    for df in (cases.table(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = sharding.shard(df).collect()
        assert len(got) == df.count()
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
        place = {(r["doc_id"], r["size"], r["text_crc32"]): r["shard"] for r in got}
        groups = defaultdict(set)
        for r in df.collect():
            b = (r["text"] or "").encode()
            groups[b].add(place[r["doc_id"], len(b) + 1, zlib.crc32(b)])
        assert all(len(g) == 1 for g in groups.values())
    assert sharding.shard(cases.empty(spark)).count() == 0


def test_bpe_equals_tiktoken(spark):
    ranks = bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, P.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é日\n\t 1'sñ😀<|endoftext|>") for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["a" * 5000, "", " " * 3000]
    for text in texts:
        assert codec.encode(text) == known.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()
    df = cases.table(spark)
    got = bpe.digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = Counter((r["doc_id"], len(i := known.encode_ordinary(r["text"] or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect())
    assert Counter(map(tuple, got)) == want
    back = bpe.decode(bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"))
    assert Counter(bytes(r["content"]) for r in back.collect()) == Counter((r["text"] or "").encode() for r in df.collect())
    assert bpe.digests(cases.empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def payload(text):
    b = (text or "").encode()
    return b + bytes(-len(b) % 64 if b else 64)


def test_flac_round_trip(spark):
    df = cases.table(spark)
    got = {r["payload_sha256"] for r in flac.digests(df).collect()}
    assert got == {hashlib.sha256(payload(r["text"])).hexdigest() for r in df.collect()}
    blocks = flac.decode_column(flac.encode_column(df.where("doc_id is not null and doc_id <> 6"))).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    pcm = defaultdict(list)
    for r in blocks:
        assert r["error"] is None
        pcm[r["doc_id"]].append((r["first_sample"], bytes(r["pcm"])))
    for d, parts in pcm.items():
        assert bytes(x ^ 0x80 for x in b"".join(p for _, p in sorted(parts))) == payload(texts[d])
    assert flac.digests(cases.empty(spark)).count() == 0


def test_flac_finds_damage():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 640).astype(np.uint8)
    stream = flac.encode(data, np.array([0, 640]))[0]
    assert not isinstance(flac.decode([stream])[0], flac.Damaged)
    for at in range(flac._metadata(stream)[0], len(stream), 7):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        assert isinstance(flac.decode([bytes(bad)])[0], flac.Damaged)
    assert isinstance(flac.decode([b""])[0], flac.Damaged)


def _tone(rng, n, depth):
    top = (1 << depth - 1) - 1
    return [max(-top, min(top, round(top * 0.4 * np.sin(i / 7) + rng.randint(-9, 9)))) for i in range(n)]


def test_flac_reads_every_kind_of_subframe():
    rng = random.Random(3)
    steps = tuple(rng.randint(-900, 900) for _ in range(12))
    kinds = [dict(kind="verbatim"), *[dict(kind="fixed", order=o) for o in range(5)], dict(kind="linear", order=1, coefficients=(900,), shift=10), dict(kind="linear", order=12, coefficients=steps, shift=9),
             dict(kind="fixed", order=2, parts=2, escape=True), dict(kind="fixed", order=1, method=1, k=17), dict(kind="verbatim", wasted=3), dict(kind="fixed", order=1, wasted=2, parts=1), dict(kind="linear", order=2, coefficients=(1800, -900), shift=10, wasted=1, escape=True)]
    streams, want = [], []
    for depth in (8, 16, 24):
        for i, how in enumerate(kinds):
            x = [v >> how.get("wasted", 0) << how.get("wasted", 0) for v in _tone(rng, 208, depth)]
            k = max(3, depth - 6)
            streams.append(flac_writer.stream([x], depth, [64, 64, 64, 16], 0, lambda s, d, j, c, how=how, k=k: flac_writer.subframe(s, d, **({"k": k} | how if how.get("method") else {**how, "k": min(k, 14)}))))
            want.append([x])
        streams.append(flac_writer.stream([[-5] * 48], depth, [32, 16], 0, lambda s, d, j, c: flac_writer.subframe(s, d, "constant")))
        want.append([[-5] * 48])
    for stream, pcm in zip(streams, want, strict=True):
        alone = flac.decode([stream])[0]
        assert not isinstance(alone, flac.Damaged), alone
    for got, pcm in zip(flac.decode(streams), want, strict=True):
        assert [c.tolist() for c in got["pcm"]] == pcm


@pytest.mark.parametrize("assignment", [1, 8, 9, 10])
@pytest.mark.parametrize("variable", [False, True])
def test_flac_reads_stereo_and_blocks_of_any_size(assignment, variable):
    rng = random.Random(assignment)
    left, right = _tone(rng, 500, 16), _tone(rng, 500, 16)
    blocks = [100, 7, 193, 200] if variable else [200, 200, 100]
    stream = flac_writer.stream([left, right], 16, blocks, assignment, lambda s, d, j, c: flac_writer.subframe(s, d, "fixed", order=(j + c) % 5, k=9), variable)
    got = flac.decode([stream])[0]
    assert not isinstance(got, flac.Damaged), got
    assert [c.tolist() for c in got["pcm"]] == [left, right] and [f[2] for f in got["frames"]] == blocks
    six = [_tone(rng, 64, 16) for _ in range(6)]
    many = flac.decode([flac_writer.stream(six, 16, [64], 5, lambda s, d, j, c: flac_writer.subframe(s, d, "verbatim"))])[0]
    assert [c.tolist() for c in many["pcm"]] == six


def test_flac_passes_over_false_headers():
    """Samples that look like the header of the next frame, its checksum included."""
    fake = bytes([0xFF, 0xF8, 0x70, 0x00]) + flac_writer.number(1) + (31).to_bytes(2, "big")
    fake += bytes([flac_writer.crc(fake, 0x07, 8)])
    x = [3] * 20 + [b - 256 if b > 127 else b for b in fake] + [7] * (64 - 20 - len(fake))
    stream = flac_writer.stream([x], 8, [32, 32], 0, lambda s, d, j, c: flac_writer.subframe(s, d, "verbatim"))
    got = flac.decode([stream])[0]
    assert not isinstance(got, flac.Damaged) and got["pcm"][0].tolist() == x


def test_flac_damage_stays_with_its_stream():
    """Any flipped bit, in the metadata too, gives an error or the same samples, and leaves the stream beside it alone."""
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(0, 256, 320), np.full(320, 65), rng.integers(60, 70, 640)]).astype(np.uint8)
    stream = flac.encode(data, np.array([0, 1280]))[0]
    good = flac.decode([stream])[0]["pcm"][0].tolist()
    for bit in range(0, 8 * len(stream), 31):
        bad = bytearray(stream)
        bad[bit // 8] ^= 1 << bit % 8
        first, second = flac.decode([bytes(bad), stream])
        assert isinstance(first, flac.Damaged) or first["pcm"][0].tolist() == good, bit
        assert second["pcm"][0].tolist() == good
    for cut in range(0, len(stream), 50):
        assert isinstance(flac.decode([stream[:cut]])[0], flac.Damaged)


def test_flac_digests_match_their_texts_row_by_row(spark):
    df = cases.table(spark).where("doc_id is not null and doc_id <> 6")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = flac.digests(df).collect()
    media = {r["doc_id"]: bytes(r["media"]) for r in flac.encode_column(df).collect()}
    assert len(got) == len(texts)
    for r in got:
        own = payload(texts[r["doc_id"]])
        x = np.frombuffer(own, np.uint8).astype(int) - 128
        signs = x < 0
        feature = f"frames={-(-len(own) // flac.BLOCK)};sum={x.sum()};squares={(x * x).sum()};least={x.min()};most={x.max()};crossings={(signs[1:] != signs[:-1]).sum()}"
        stored = media[r["doc_id"]]
        want = (len((texts[r["doc_id"]] or "").encode()), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
        assert tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    out = corpus_pipeline.run(spark, SF)
    kept = [r["doc_id"] for r in out.collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= ids and len(kept) > 0.7 * len(ids)


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Every stage's effect on every row, each from the definition, on what the one before it kept."""
    rng = random.Random(11)
    vocabulary = [a + b + c for a in "bdfg" for b in "aeo" for c in "lmnr"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, passage = [line(6) for _ in range(3)], line(30)
    texts = []
    for i in range(150):
        lines = [line(rng.randint(3, 14)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            lines.append(rng.choice(["scum", "moron"]) + " " + line(4) + " scum moron")
        if i % 6 == 1:
            lines[1:1] = shared
        if i % 7 == 2:
            lines[0] += " " + passage + " " + line(2)
        texts.append("\n".join(lines))
    texts[40:44] = [texts[3], texts[4].replace(" ", "  ", 1), texts[8] + " tail", None]
    rows = list(enumerate(texts))
    toxic = {i: int(i % 5 == 0) for i in range(100)}
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1, t) for d, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    fresh = {r[0] for r in spark.range(100).where("pmod(xxhash64(id, 'part'), 3) = 0").collect()}
    scores = cases.toxic_scores(rows, toxic, fresh)
    kept = [(d, t) for d, t in rows if scores[d][0] < 0.5]
    assert 0 < len(kept) < len(rows)
    cut = test_dedup._line_runs(kept)
    kept = [(d, cut[d, t]) for d, t in kept]
    groups = test_dedup._similar(kept)
    kept = [(d, t) for d, t in kept if groups[d] == d]
    cut = cases.without_repeated_bytes(kept)
    lengths = {d: len((cut[d] or "").split()) for d, _ in kept}

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {d: r["n_tokens"] for d, r in got.items()} == lengths
    for k in {r["bucket"] for r in got.values()}:
        own = [r for r in got.values() if r["bucket"] == k]
        assert {r["padded_tokens"] for r in own} == {max(r["n_tokens"] for r in own)}
    each = sorted(Counter(lengths.values()).items())
    best = packing.boundaries([n for _, n in each], [x * n for x, n in each], [x for x, _ in each], packing.BUCKETS)
    assert sorted({r["padded_tokens"] for r in got.values()}) == best


def test_stages_take_awkward_rows(spark):
    narrow = cases.table(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for table in (narrow, narrow.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == narrow.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_a_long_text_is_coded_in_blocks():
    """Thirty million bytes through encoder and decoder, in a process of its own, in under 800 MB."""
    code = """
import resource
import numpy as np
from stratiform.llm import flac
raw = np.tile(np.random.default_rng(1).integers(97, 123, 64 * 1000, dtype=np.uint8), 470)
media = flac.encode(raw, np.array([0, len(raw)]))
got = flac.decode(media)[0]
assert all((got["pcm"][0][a : a + 10**6] + 128 == raw[a : a + 10**6]).all() for a in range(0, len(raw), 10**6)) and len(got["frames"]) == len(raw) // 256
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout) < 800
