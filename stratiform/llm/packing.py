"""Packing into length buckets that minimise padding.

The global histogram has a cell for each different length. Dynamic programming over all of them chooses the bucket
boundaries with the least padding: `best[k][i] = min over j of best[k-1][j] + cost(j, i)`, where the cost of padding
lengths j..i to the longest of them is a line in that length, so each layer is a lower envelope of lines, found in
linear time. The histogram is bounded: n different lengths take n(n - 1)/2 words of text at least, so a corpus of 10^13
words has fewer than 4.5 million of them. Inside a bucket, batches take as many texts as fit the token budget at the
bucket's padded length.

Defined results: a null or blank text has no tokens and falls into the first bucket; a text longer than the budget
has a batch to itself; ties are broken by id and then by a hash of the text, and rows equal in both are
interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import ranked, written

BUCKETS = 8
#: Tokens of a batch, padding included.
BATCH_TOKENS = 65_536


def token_count(text: str | Column) -> Column:
    """Words between ASCII white space, the length that batches are budgeted by."""
    words = F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return words.cast("long")


def boundaries(counts: list[int], sums: list[int], tops: list[int], buckets: int) -> list[int]:
    """The padded lengths of at most `buckets` buckets with the least total padding.

    Cells come in order of length: texts in each, their summed length, the longest of them.
    """
    n = len(counts)
    if not n:
        return []
    n_before, s_before = [0], [0]
    for c, s in zip(counts, sums, strict=True):
        n_before.append(n_before[-1] + c)
        s_before.append(s_before[-1] + s)
    best = [0] + [None] * n
    froms = []
    for _ in range(min(buckets, n)):
        lines: list[tuple[int, int, int]] = []  # slope, intercept, cell; slopes fall
        head, layer, source = 0, [None] * (n + 1), [0] * (n + 1)
        layer[0] = 0
        for i in range(1, n + 1):
            if best[i - 1] is not None:
                new = (-n_before[i - 1], best[i - 1] + s_before[i - 1], i - 1)
                while len(lines) - head >= 2 and _useless(lines[-2], lines[-1], new):
                    lines.pop()
                lines.append(new)
            if head < len(lines):
                x = tops[i - 1]
                while head + 1 < len(lines) and lines[head + 1][0] * x + lines[head + 1][1] <= lines[head][0] * x + lines[head][1]:
                    head += 1
                layer[i] = lines[head][0] * x + lines[head][1] + x * n_before[i] - s_before[i]
                source[i] = lines[head][2]
        best = layer
        froms.append(source)
    out, i = [], n
    for source in reversed(froms):
        if i == 0:
            break
        out.append(tops[i - 1])
        i = source[i]
    return out[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c (slopes a > b > c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(df: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, bucket, padded_tokens, batch, slot) for each row.

    `bucket` numbers the buckets by length; `padded_tokens` is the length all its texts are padded to; `batch`
    numbers the batches of the bucket and `slot` the texts of the batch.
    """
    narrow = written(df.select(F.col(id_col).alias("__id"), token_count(text_col).alias("n_tokens"), F.xxhash64(text_col).alias("__hash")), "lengths")
    histogram = narrow.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")  # bounded: see above
    lengths, counts = histogram.column(0).to_pylist(), histogram.column(1).to_pylist()
    tops = boundaries(counts, [x * n for x, n in zip(lengths, counts, strict=True)], lengths, buckets)
    n_rows = sum(counts)
    length = F.col("n_tokens")
    bucket = sum((F.when(length > top, 1).otherwise(0) for top in tops[:-1]), F.lit(0)).cast("int")
    padded = F.lit(tops[-1] if tops else 0)
    for top in reversed(tops[:-1]):
        padded = F.when(length <= top, F.lit(top)).otherwise(padded)
    placed = ranked(narrow.withColumn("bucket", bucket), "bucket", ["__id", "__hash"], "__place", n_rows)
    per_batch = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest(F.col("padded_tokens"), F.lit(1))), F.lit(1)).cast("long")
    return (
        placed.withColumn("padded_tokens", padded.cast("long"))
        .withColumn("__per", per_batch)
        .select(F.col("__id").alias(id_col), "n_tokens", "bucket", "padded_tokens", F.floor(F.col("__place") / F.col("__per")).cast("long").alias("batch"), (F.col("__place") % F.col("__per")).cast("int").alias("slot"))
    )
