"""Resampling by importance towards a target corpus, over inverted postings that are partitioned by feature bucket.

A text's features are its runs of 1 to `order` words, hashed into `BUCKETS` buckets. Each task inverts slices of the
corpus into posting blocks, (bucket, documents, counts), which are shuffled by bucket. There the bucket's counts in
both corpora meet, its gain is computed in place (the log ratio of the smoothed rates), and each posting turns into a
contribution to its document; contributions are summed by document, first in each task. Scores are means of gains plus
seeded Gumbel noise, so that the highest ones are a draw without replacement in proportion to the importance.

A bucket may hold a third of all postings: its blocks are spread over `SALTS` parts, of a slice each, and only the
counts (at most `BUCKETS` rows) are repeated for them. Places among equal scores start where the better scores end;
scores are whole numbers within about 10^5 of each other, so the table of their counts is bounded.

Defined results: a null text, like one without words, has no features and the weight 0; a null id draws its noise as the
empty text does and comes last among equal scores; repeated rows are documents of their own with equal scores; an empty
target leaves a constant prior, and an empty corpus gives an empty result; other columns are not read. A text's words
are taken in pieces of about `PIECE` bytes, so a very long one needs memory for its different features only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm.common import starts_of, written

BUCKETS, ORDER, SEED = 10_000, 1, 2024
#: Documents need so many words to be drawn, and so many in a hundred of these are.
LEAST_WORDS, PERCENT = 20, 10
#: Parts over which a bucket's posting blocks are spread.
SALTS = 16
#: Postings of one slice, and bytes of text that are split at a time.
SLICE_POSTINGS, PIECE = 1 << 20, 1 << 20

#: Word bytes are digits, letters and all beyond ASCII, so words of UTF-8 bytes are words of characters.
_AS_WORDS = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for each piece."""
    lo, n = 0, len(data)
    while lo < n:
        hi = n if n - lo <= PIECE else data.find(b" ", lo + PIECE)
        hi = n if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def features(text: str | None, order: int = ORDER) -> tuple[Counter, int]:
    """(counts of features, number of words)."""
    counts, total, last = Counter(), 0, []
    for words in _words((text or "").encode().translate(_AS_WORDS)):
        total += len(words)
        counts.update(words)
        for n in range(2, order + 1):
            near = last[len(last) - n + 1 :] + words if n - 1 <= len(last) else last + words
            counts.update(map(b" ".join, zip(*(near[i:] for i in range(n)), strict=False)))
        last = (last + words)[max(0, len(last) + len(words) - order + 1) :]
    return counts, total


class _Slice:
    """The postings of some neighbouring documents."""

    def __init__(self, base: int):
        self.base, self.n_docs, self.parts, self.size = base, 0, [], 0

    def add(self, counts: Counter, buckets: int) -> None:
        found = np.fromiter((crc32(f) % buckets for f in counts), np.int64, len(counts))
        self.parts.append((found, np.full(len(counts), self.n_docs, np.int64), np.fromiter(counts.values(), np.int64, len(counts))))
        self.n_docs += 1
        self.size += len(counts)

    def blocks(self) -> pa.RecordBatch:
        bucket, doc, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((doc, bucket))
        bucket, doc, n = bucket[order], doc[order], n[order]
        first = np.flatnonzero(starts_of(bucket, doc))
        bucket, doc, n = bucket[first], doc[first], np.add.reduceat(n, first) if len(first) else n
        at = np.flatnonzero(starts_of(bucket))
        ends = pa.array(np.append(at, len(bucket)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (doc, n)]
        total = np.add.reduceat(n, at) if len(at) else n
        return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), self.base), pa.int64()), *lists, pa.array(total, pa.int64())], ["bucket", "key", "docs", "counts", "total"])


def postings(df: DataFrame, order: int, buckets: int, id_col: str | None, text_col: str, name: str) -> DataFrame:
    """A written table of posting blocks (bucket, key of the slice's first document, docs, counts, total), documents
    numbered from that key on, and of a row (null bucket, key, id, n_words, total of features) for each document.

    Without `id_col` the latter are left out.
    """
    kind = df.schema[id_col].dataType.simpleString() if id_col else "int"
    schema = f"bucket int, key long, docs array<int>, counts array<int>, total long, id {kind}, n_words long"
    types = ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))

    def heads(batch: pa.RecordBatch, n_words: list[int], n_features: list[int]) -> pa.RecordBatch:
        n = len(n_words)
        nothing = [pa.nulls(n, kind) for _, kind in types]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), batch.column(0), *nothing, pa.array(n_features, pa.int64()), batch.column(1), pa.array(n_words, pa.int64())], ["bucket", "key", "docs", "counts", "total", "id", "n_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n_words, n_features = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                counts, words = features(text.as_py(), order)
                n_words.append(words)
                n_features.append(counts.total())
                held = held or _Slice(key)
                held.add(counts, buckets)
                if held.size >= SLICE_POSTINGS or held.n_docs >= SLICE_POSTINGS:
                    yield whole(held.blocks(), batch)
                    held = None
            if id_col:
                yield heads(batch, n_words, n_features)
        if held:
            yield whole(held.blocks(), batch)

    def whole(blocks: pa.RecordBatch, like: pa.RecordBatch) -> pa.RecordBatch:
        n = blocks.num_rows
        return pa.RecordBatch.from_arrays([*blocks.columns, pa.nulls(n, like.column(1).type), pa.nulls(n, pa.int64())], [*blocks.schema.names, "id", "n_words"])

    keyed = df.select(F.monotonically_increasing_id().alias("key"), (F.col(id_col) if id_col else F.lit(None).cast("int")).alias("id"), F.col(text_col).alias("text"))
    return written(keyed.mapInArrow(run, schema), name)


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of each bucket of the corpus, from both corpora's posting blocks: at most `buckets` rows."""
    own = corpus.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("total").alias("s"))
    wanted = target.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("total").alias("t"))
    counts = written(own.join(wanted, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "counts")
    s, t = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ratio = (F.col("t") + 1).cast("double") * float(s + buckets) / ((F.col("s") + 1).cast("double") * float(t + buckets))
    return counts.where("s > 0").select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def contributions(blocks: DataFrame, gain: DataFrame) -> DataFrame:
    """(key, total): the sum of a document's gains, repeats included. Blocks and gains meet by bucket and part."""
    parts = blocks.where("bucket IS NOT NULL").select("bucket", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"), "key", "docs", "counts")
    spread = gain.select("bucket", "gain", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = parts.join(spread.hint("shuffle_hash"), ["bucket", "salt"])
    each = met.select("key", "gain", F.explode(F.arrays_zip("docs", "counts")).alias("p"))
    return each.groupBy((F.col("key") + F.col("p.docs")).alias("key")).agg(F.sum(F.col("p.counts") * F.col("gain")).alias("total_gain"))


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of a document, from the hash of the seed and its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of `df`; rank is null for what is not drawn."""
    own = postings(df, order, buckets, id_col, text_col, "postings")
    wanted = postings(target, order, buckets, None, target_text_col, "target")
    totals = contributions(own, gains(own, wanted, buckets))
    heads = own.where("bucket IS NULL").select("key", "id", "n_words", F.col("total").alias("n_features"))
    # Whole-number division that goes down; a document without features has no total.
    weight = F.coalesce(F.expr("(total_gain - pmod(total_gain, n_features)) DIV n_features"), F.lit(0)).cast("long")
    weighed = heads.join(totals, "key", "left").withColumn("weight", weight).drop("total_gain")
    scored = written(weighed.withColumn("score", F.col("weight") + noise("id", seed)), "scored")
    return ranked_draw(scored, least_words, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def ranked_draw(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """`scored` with `rank`: of the n rows with enough words, the percent * n / 100 of highest score count from 1."""
    enough = F.col("n_words") >= least_words
    sizes = scored.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # As many rows as there are different scores, a bounded number, so one task may number them.
    before = Window.orderBy(F.col("score").desc())
    starts = sizes.select("score", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    draw = percent * scored.where(enough).count() // 100
    place = F.row_number().over(Window.partitionBy("score", enough).orderBy(F.col("id").asc_nulls_last(), "key"))
    rank = F.when(enough, F.col("start") + place)
    return scored.join(F.broadcast(starts.where(F.col("start") < draw)), "score", "left").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))


_CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
#: crc32 in SQL: its table, and the checksum of the bytes of a text column.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) ORDER BY i) AS t FROM range(256) AS r(i))"


def crc32_sql(column: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, where `crc` is in the FROM clause."""
    digits = f"hex(encode({column}))"
    return _CRC.format(bytes=f"list_transform(range(1, length({digits}) + 1, 2), lambda i: ('0x' || substr({digits}, i, 2))::BIGINT)")


ORACLE_SQL = f"""
WITH {CRC_TABLE},
words AS (
  SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
counted AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
places AS MATERIALIZED (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM counted), crc),
posted AS (SELECT side, doc_id, bucket, sum(n)::BIGINT AS n FROM counted JOIN places USING (word) GROUP BY ALL),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM posted GROUP BY bucket),
sums AS (SELECT sum(s) AS s, sum(t) AS t FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((b.t + 1) * (sums.s + 10000) / ((b.s + 1) * (sums.t + 10000))))::BIGINT AS gain FROM buckets b, sums),
totals AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS total FROM posted JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM documents d LEFT JOIN totals USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
places_of AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN places_of USING (doc_id)
"""
