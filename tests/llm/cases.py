"""A table of awkward rows, and brute-force versions of what the operators do to it."""

import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, tag string, fp string, bucket int, term string, label int, doc string, spans string, key string"
WORDS = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"]


def rows():
    passage = "this passage of well over fifty bytes stands in several documents word for word"
    lines = "first line here\nsecond line there\nthird line elsewhere\nfourth line"
    texts = [
        (1, passage + " one"), (2, "before " + passage), (3, None), (4, ""), (5, " \t\n "), (6, passage + " one"), (6, passage + " one"),
        (7, lines), (8, "x\n" + lines + "\ny"), (9, lines + "\n" + lines), (10, "é😀 ü " * 40), (11, "é😀 ü " * 41), (None, passage + " nobody"), (None, None),
        (12, " ".join(f"w{i % 997}" for i in range(20_000))), (13, " ".join(f"w{i % 997}" for i in range(20_001))), (14, "a" * 500), (15, "b" * 49), (16, "b" * 50), (17, "b" * 51),
        (18, "The Same Four Words Again And Then Some More Of Them To Fill"), (19, "the same four words again and then some more of them to fill"), (20, "IDIOT scum"), (21, "## $$ %% && || << >>"),
    ]
    return [(d, t, None if i % 3 else "en", f"s{i}", None if i % 4 else len(t or ""), i, "tag", "fp", i, "t", 1, "d", "s", "k") for i, (d, t) in enumerate(texts)]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def kept_bytes(pairs, length=50):
    """{id: (bytes, removed, runs, sha256)} for (id, text) pairs; None is the greatest id."""
    order = lambda d: float("inf") if d is None else d
    seen, out = {}, []
    for d, t in pairs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            seen[s] = min(seen.get(s, float("inf")), order(d))
    for d, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < order(d):
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """[(id, component)] for (id, fingerprint) pairs with ids."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, f) in enumerate(prints):
        for j, (_, g) in enumerate(prints[:i]):
            if (f ^ g).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least.get(root(i))) for i, (d, _) in enumerate(prints)]


def _words(text):
    out = {}
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out[w] = out.get(w, 0) + 1
    return out


def toxic_scores(rows, toxic, fresh):
    """{id: (score, [(example, cosine)])} for (id, text) rows with different ids: all cosines, votes, and the isotonic fit.

    `toxic` gives the labels by id, of which those held out are not learned from; `fresh` the ids kept from the relevances.
    """
    counts = {d: _words(t) for d, t in rows}
    sample = sorted(d for d in toxic if zlib.crc32(str(d).encode()) % 5 and d in counts)
    old = [d for d in sample if d not in fresh]
    sizes = [sum(toxic[d] == k for d in old) for k in (0, 1)]

    def importance(t):
        seen = sum(t in own for own in counts.values())
        a, c = (sum(t in counts[d] and toxic[d] == k for d in old) + 0.5 for k in (1, 0))
        ratio = math.log(a / (sizes[1] + 1) / (c / (sizes[0] + 1)))
        return math.log((1 + len(rows)) / (1 + seen)) * (1 + 2 * max(0.0, ratio - 2 * math.sqrt(1 / a + 1 / c)))

    heavy = {t: importance(t) for t in {t for d in sample for t in counts[d]}}

    def vector(own):
        w = {t: (1 + math.log(n)) * heavy[t] for t, n in own.items() if t in heavy}
        size = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / size for t, x in w.items()}

    vectors = {d: vector(counts[d]) for d in sample}

    def near(own, skip):
        sims = {d: sum(w * vectors[d].get(t, 0) for t, w in own.items()) for d in sample if d != skip}
        best = sorted((x for x in sims.items() if x[1] > 0), key=lambda x: -x[1])[:15]
        return best, (sum(s * toxic[d] for d, s in best) / sum(s for _, s in best) if best else None)

    tried = [(near(vectors[d], d)[1], toxic[d]) for d in sample if d in fresh]
    alone = [y for x, y in tried if x is None]
    known = sorted((x, y) for x, y in tried if x is not None)
    pools = []
    for x in sorted({x for x, _ in known}):
        pools.append([[y for v, y in known if v == x], [x]])
        while len(pools) > 1 and np.mean(pools[-2][0]) >= np.mean(pools[-1][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1]]
    at, rate = [v for p in pools for v in (p[1][0], p[1][-1])], [np.mean(p[0]) for p in pools for _ in range(2)]
    out = {}
    for d, own in counts.items():
        best, share = near(vector(own), d)
        out[d] = (np.mean(alone) if alone else 0.0) if share is None else np.interp(share, at, rate) if at else share, best
    return out


def without_repeated_bytes(rows):
    """{id: kept text} for (id, text) rows with different ids."""
    seen, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            seen[b[i : i + 50]] = min(seen.get(b[i : i + 50], d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out[d] = t if not any(gone) else bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out
