"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest.

A rule names a host, which stands for its subdomains too, and the beginning of a path; the longest fitting rule
decides. URLs that rules decide are the labelled ones: trees are boosted on them with the logistic loss, on
quantile-binned features, and judge the URLs that no rule fits. Features are the lengths and depths of host and path,
shares of digits and other characters, entropies, parameters, and suffix statistics: the block rates of the host's
last one and two labels, of the path's ending and, likewise, of its first segment. A suffix's rate is the mean over the hosts that have it, of all
labelled URLs, drawn towards the overall rate by `SMOOTHING` hosts; in training a URL's own host is left out of it, so
that the trees learn how far a suffix says something about hosts that are not known.

Trees are fitted on at most `TRAIN_ROWS` different labelled URLs, those of least hash, each weighted by its rows; the
suffix statistics cover all, and are joined to the URLs.

Defined results: a null URL, or one without `://`, has an empty host and path, which no rule fits; without labelled
URLs the verdict of the rest is allow, and with one class only it is that class; repeated rows get equal verdicts; an
empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import utf8, written

#: (host, path, verdict): the stated rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 4, 0.15, 32, 10, 1.0
#: Smoothing of suffix rates towards the overall rate, in hosts.
SMOOTHING = 5.0
#: The keys of the suffix statistics: the host's last label, its last two, the path's ending, and where the path begins.
#: Suffix keys, and what their values begin with.
KEYS = {"last_label": "1:", "last_two_labels": "2:", "ending": "e:", "first_segment": "p:"}
#: URLs whose features are computed together.
STEP = 4096


# ---------------------------------------------------------------- host, path, rules and suffixes, as columns


def host_of(url: str) -> Column:
    after = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, as host and path in one string; null if none fits."""
    out = F.lit(None).cast("string")
    for name, start, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.lit(name + start)).otherwise(out)
    return out


def query_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^[^?#]*\\?([^#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column) -> dict[str, Column]:
    last = F.regexp_extract(path, "(?s)([^/]*)$", 1)
    ending = F.when(last == "", "/").when(F.contains(last, F.lit(".")), F.regexp_extract(last, "(?s)([^.]*)$", 1)).otherwise("")
    return {
        "last_label": F.concat(F.lit(KEYS["last_label"]), F.regexp_extract(host, "(?s)([^.]*)$", 1)),
        "last_two_labels": F.concat(F.lit(KEYS["last_two_labels"]), F.regexp_extract(host, "(?s)((?:[^.]*\\.)?[^.]*)$", 1)),
        "ending": F.concat(F.lit(KEYS["ending"]), ending),
        "first_segment": F.concat(F.lit(KEYS["first_segment"]), F.regexp_extract(path, "^/*([^/]*)", 1)),
    }


# ---------------------------------------------------------------- features


def _classes(*groups: bytes) -> np.ndarray:
    out = np.zeros((len(groups), 256), bool)
    for row, group in zip(out, groups, strict=True):
        row[list(group)] = True
    return out


_DIGITS, _UPPER, _LOWER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_OF_URL = _classes(_DIGITS, _UPPER + _LOWER, _UPPER, b"-", b"%", b"#")


def _counts(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Bytes of each class in each text."""
    sums = np.zeros((len(classes), len(raw) + 1), np.int64)
    np.cumsum(classes[:, raw], axis=1, out=sums[:, 1:])
    return (sums[:, offsets[1:]] - sums[:, offsets[:-1]]).T


def _entropies(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of entropy of each text's bytes."""
    sizes = np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 256 + raw, minlength=256 * len(sizes)).reshape(-1, 256)
    share = counts / np.maximum(sizes, 1)[:, None]
    return -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(1)


def _pieces(raw: np.ndarray, offsets: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """(pieces that are not empty, length of the longest one) of each text, cut at a separator."""
    sizes, at = np.diff(offsets), np.arange(len(raw))
    last = np.maximum.accumulate(np.where(raw == separator, at, -1)) if len(raw) else at
    run = at - np.maximum(last, np.repeat(offsets[:-1], sizes) - 1)
    sums = np.append(0, np.cumsum(run == 1))
    longest = np.zeros(len(sizes), np.int64)
    if len(raw):
        longest[sizes > 0] = np.maximum.reduceat(run, offsets[:-1][sizes > 0])
    return sums[offsets[1:]] - sums[offsets[:-1]], longest


def features(url: pa.Array, host: pa.Array, path: pa.Array, query: pa.Array) -> np.ndarray:
    """The lexical features of each URL, in rows; lengths are in bytes."""
    parts = [utf8(c) for c in (url, host, path, query)]
    url_size, host_size, path_size, query_size = (np.diff(offsets) for _, offsets in parts)
    digits, letters, upper, hyphens, percents, hashes = _counts(*parts[0], _OF_URL).T
    labels, longest_label = _pieces(*parts[1], ord("."))
    depth, longest_segment = _pieces(*parts[2], ord("/"))
    ands = _counts(*parts[3], _classes(b"&"))[:, 0]
    secure = pc.starts_with(pc.ascii_lower(url), "https://").to_numpy(zero_copy_only=False)
    n = np.maximum(url_size, 1)
    return np.column_stack(
        [
            url_size, host_size, path_size, query_size, labels, longest_label, depth, longest_segment, digits / n, letters / n, upper / n, hyphens, percents,
            _counts(*parts[1], _classes(_DIGITS))[:, 0] / np.maximum(host_size, 1), _entropies(*parts[1]), _entropies(*parts[2]),
            np.where(query_size > 0, ands + 1, 0), hashes > 0, secure,
        ]
    ).astype(np.float64)


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Features and suffix rates of a batch that has the columns url, host, path, query and a rate for each key."""
    columns = [batch.column(name) for name in ("url", "host", "path", "query")]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    rates = [np.asarray(batch.column(f"{key}_rate").to_numpy(), np.float64) for key in KEYS]
    return np.column_stack([features(*columns), *rates])


# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """Trees as flat arrays: node k has the children 2k+1 and 2k+2; a leaf has feature -1."""

    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[node] >= 0
                right = x[rows, feature[node]] > threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out

    def rate(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Trees:
    """Boosted trees of the logistic loss by second-order gains over binned features."""
    weights = np.ones(len(y)) if weights is None else weights / weights.mean()
    mean = np.clip(weights @ y / weights.sum(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(mean / (1 - mean))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    margin, size = np.full(len(y), model.start), 2 ** (DEPTH + 1) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = weights * (y - p), weights * p * (1 - p)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        own = {0: np.arange(len(y))}
        for node in range(size):
            rows = own.pop(node, None)
            if rows is None:
                continue
            g, h = gradient[rows].sum(), curvature[rows].sum()
            value[node] = RATE * g / (h + RIDGE)
            best = (1e-6, -1, 0)
            if 2 * node + 2 < size and len(rows) >= 2 * LEAST_ROWS:
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    b = binned[rows, f]
                    k = len(edges[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (gradient[rows], curvature[rows], None))
                    gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                    gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = 0
                    cut = int(gain.argmax())
                    if gain[cut] > best[0]:
                        best = (float(gain[cut]), f, cut)
            if best[1] < 0:
                margin[rows] += value[node]
                continue
            feature[node], threshold[node] = best[1], edges[best[1]][best[2]]
            left = binned[rows, best[1]] <= best[2]
            own[2 * node + 1], own[2 * node + 2] = rows[left], rows[~left]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.values.append(value)
    return model


# ---------------------------------------------------------------- the operator


def parsed(df: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, host, path, query, rule, suffix keys) of each row."""
    parts = df.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), host_of(url_col).alias("host"), path_of(url_col).alias("path"), query_of(url_col).alias("query"))
    return parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), *[c.alias(k) for k, c in keys_of(F.col("host"), F.col("path")).items()])


@dataclass
class Model:
    """Trees, if both classes are known; the overall block rate; by kind of key (key, total, hosts), the suffix statistics.

    Each kind is a table of its own. So the few top-level domains, whose rows are the hottest keys of all, stay below the size up to
    which Spark broadcasts a table, however many first segments there are.
    """

    trees: Trees | None
    base: float
    suffixes: dict[str, DataFrame]


def rated(urls: DataFrame, suffixes: dict[str, DataFrame], base: float, own: DataFrame | None = None) -> DataFrame:
    """`urls` with the rate of each suffix; `own` (key, host, rate) is what a URL's own host gives, and is left out."""
    for key in KEYS:
        stats = suffixes[key].select(F.col("key").alias(key), F.col("total").alias("__total"), F.col("hosts").alias("__hosts"))
        urls = urls.join(stats, key, "left")
        total, hosts = F.coalesce("__total", F.lit(0.0)), F.coalesce("__hosts", F.lit(0))
        if own is not None:
            urls = urls.join(own.select(F.col("key").alias(key), "host", F.col("rate").alias("__own")), [key, "host"], "left")
            total, hosts = total - F.coalesce("__own", F.lit(0.0)), hosts - F.col("__own").isNotNull().cast("int")
        urls = urls.withColumn(f"{key}_rate", (total + SMOOTHING * base) / (hosts + SMOOTHING)).drop("__total", "__hosts", "__own")
    return urls


def train(labelled: DataFrame) -> Model:
    """The model of `parsed` URLs that have a `blocked` of 0 or 1."""
    urls = written(labelled.groupBy("url", "host", "path", "query", "blocked", *KEYS).agg(F.count(F.lit(1)).alias("n")), "labelled")
    by_host = urls.select("host", "n", "blocked", F.explode(F.array(*KEYS)).alias("key")).groupBy("key", "host")
    own = written(by_host.agg((F.sum(F.col("n") * F.col("blocked")) / F.sum("n")).alias("rate")), "own")
    sums = own.groupBy("key").agg(F.sum("rate").alias("total"), F.count(F.lit(1)).alias("hosts"))
    suffixes = {key: written(sums.where(F.col("key").startswith(start)), f"suffixes_{key}") for key, start in KEYS.items()}
    total = urls.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("blocked")), F.lit(0)).alias("blocked")).first()
    if total["blocked"] in (0, total["n"]):
        return Model(None, float(total["blocked"] > 0), suffixes)
    base = total["blocked"] / total["n"]
    sample = urls.orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS)
    rows = rated(sample, suffixes, base, own).toArrow().sort_by("url")  # bounded by TRAIN_ROWS
    return Model(fit(_matrix(rows), rows.column("blocked").to_numpy().astype(np.float64), rows.column("n").to_numpy().astype(np.float64)), base, suffixes)


def scored(urls: DataFrame, model: Model) -> DataFrame:
    """(id, host, path, rule, score) of `parsed` URLs; `score` is the trees' rate of being blocked."""
    sent = urls.sparkSession.sparkContext.broadcast(cloudpickle.dumps((model.trees, model.base)))  # bounded by TREES and DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, base = pickle.loads(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                score = trees.rate(_matrix(part)) if trees else np.full(part.num_rows, base)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("id", "host", "path", "rule")), pa.array(score)], ["id", "host", "path", "rule", "score"])

    kind = urls.schema["id"].dataType.simpleString()
    with_rates = rated(urls, model.suffixes, model.base).select("id", "url", "host", "path", "query", "rule", *[f"{key}_rate" for key in KEYS])
    return with_rates.mapInArrow(run, f"id {kind}, host string, path string, rule string, score double")


def judge(df: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for each row."""
    parts = written(parsed(df, rules, id_col, url_col), "urls")
    blocking = [name + start for name, start, verdict in rules if verdict == "block"]
    by_rule = F.when(F.col("rule").isin(blocking), "block").when(F.col("rule").isNotNull(), "allow")
    model = train(parts.where("rule is not null").withColumn("blocked", (by_rule == "block").cast("int")))
    verdict = F.coalesce(by_rule, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored(parts, model).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
