"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a column that is true where a text fails it. On a bounded sample of `SAMPLE_ROWS` texts each rule's
rejection rate is counted and its cost is measured: the least time of `RUNS` runs over the sample, less that of a rule
that does nothing. The rules are then put in order of rejections per cost and nested in one CASE, so that a text which
fails one rule is not measured by the next. The order changes the work, never the verdict.

Words are runs of characters that are not ASCII white space. Repeated windows are found inside a row. The hash of a
window of eight words is made of two hashes of four, and these of two each, so a word is hashed once. Only where two
windows of a text agree are their hashes sorted with their places; equal neighbours then give the places that repeat,
and the words that these windows cover are counted in order of place.

Defined results: a null, empty or blank text has no words and fails the base rule; repeated rows get equal results;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import written

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
#: Different texts on which the rules' rejection rates are estimated, those of least hash.
SAMPLE_ROWS = 2000
#: Runs of each rule over the sample, of which the shortest counts; least cost of a rule, in seconds.
RUNS, LEAST_COST = 3, 1e-3


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def _text() -> Column:
    return F.col("__text")


def _without(characters: str) -> Column:
    return F.char_length(F.translate(_text(), characters, ""))


def _share(characters: Column) -> Column:
    return characters / F.greatest(F.col("word_chars"), F.lit(1))


def rules() -> list[Rule]:
    """The rules beyond the base one; `n_words`, `word_chars`, `n_symbols` and `n_dup_lines` are there already."""
    letters = F.char_length(F.regexp_replace(_text(), "[^\\p{L}]+", ""))
    upper = F.char_length(F.regexp_replace(_text(), "[^\\p{Lu}]+", ""))
    lines = F.regexp_count(_text(), F.lit("(?md)^.*[^\\x20\\x09-\\x0D]"))
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("word_length", ~mean.between(2.0, 15.0)),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > lines * 3),
        Rule("letters", _share(letters) < 0.6),
        Rule("capitals", _share(upper) > 0.5),
        Rule("ellipses", F.regexp_count(_text(), F.lit("(?md)(\\.\\.\\.|…)[\\x20\\x09\\x0D]*$")) * 10 > lines * 3),
    ]


def window_hashes(df: DataFrame) -> DataFrame:
    """`df` with the array `__h`: the hash of each WINDOW-word window of `__words`."""
    out = df.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        # Past the end a hash meets null; those are no windows and go at last.
        out = out.withColumn("__h", F.zip_with("__h", F.slice("__h", step + 1, F.greatest(F.size("__h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    return out.withColumn("__h", F.slice("__h", 1, F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0))))


def repeated_words() -> Column:
    """Words in WINDOW-word windows that a text has twice or more, from `__h`."""
    # Each array(x) -> x binds a value once; without it the lambdas below would compute it for each element.
    again = "zip_with(sorted, concat(slice(sorted, 2, size(sorted)), array(CAST(NULL AS struct<h: bigint, i: int>))), (a, b) -> a.h <=> b.h)"
    places = f"""array_sort(flatten(transform(array({again}), again -> filter(zip_with(
        zip_with(again, concat(array(false), slice(again, 1, size(again) - 1)), (next, last) -> next OR last),
        sorted, (repeated, x) -> if(repeated, x.i, NULL)), i -> i IS NOT NULL))))"""
    hashes = "transform(__h, (h, i) -> struct(h, i))"
    count = f"aggregate(flatten(transform(array(array_sort({hashes})), sorted -> {places})), struct(0 AS total, -{WINDOW} AS last), (acc, i) -> struct(acc.total + least({WINDOW}, i - acc.last) AS total, i AS last), acc -> acc.total)"
    return F.expr(f"if(size(array_distinct(__h)) = size(__h), 0, {count})")


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    with_text = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    bare = F.btrim("__text", F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    with_words = window_hashes(with_text.withColumn("__words", words))
    lines = F.filter(F.split("__text", "\n", -1), lambda line: F.translate(line, SPACES, "") != "")
    out = with_words.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": _without(SPACES).cast("long"),
            "n_symbols": (F.char_length("__text") - _without(SYMBOLS)).cast("long"),
            "n_dup_lines": F.element_at(F.transform(F.array(lines), lambda own: F.size(own) - F.size(F.array_distinct(own))), 1).cast("long"),
            "n_repeat_words": repeated_words().cast("long"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__words", "__h")


def ordered(df: DataFrame, text_col: str = "text") -> list[Rule]:
    """The rules by rejections per cost, most first, as a sample of `df` shows them."""
    own, mark = rules(), F.xxhash64(text_col)
    # Only hashes meet in one task; the texts stay where they are until the sample is known.
    top = df.select(mark.alias("h")).distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    sample = df.where(mark <= (0 if top is None else top)).groupBy(mark.alias("h")).agg(F.first(text_col).alias(text_col))
    found = written(measured(sample, text_col).where("not base_failed").drop(text_col), "sample")
    rates = found.agg(*[F.avg(F.when(r.fails, 1.0).otherwise(0.0)).alias(r.name) for r in own]).first()
    idle = _seconds(found, F.col("__text").isNull())
    costs = {r.name: max(_seconds(found, r.fails) - idle, LEAST_COST) for r in own}
    return sorted(own, key=lambda r: (-(rates[r.name] or 0.0) / costs[r.name], costs[r.name], r.name))


def _seconds(sample: DataFrame, rule: Column) -> float:
    took = []
    for _ in range(RUNS):
        began = time.perf_counter()
        sample.agg(F.count_if(rule)).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row."""
    narrow = df.select(id_col, text_col)
    cascade = F.when(F.col("base_failed"), False)
    for rule in ordered(narrow, text_col):
        cascade = cascade.when(rule.fails, False)
    return measured(narrow, text_col).withColumn("kept", cascade.otherwise(True)).drop("__text", text_col)


ORACLE_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM texts),
windows AS (
  SELECT doc_id, i, words[i:i + 7] AS own
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM words) WHERE len(words) >= 8),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, own) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) AS r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS different, count(*) FILTER (WHERE regexp_matches(line, '(\\.\\.\\.|…)[\\x20\\x09\\x0D]*$')) AS ellipses
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, text, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n - l.different, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         coalesce(l.n, 0) AS n_lines, coalesce(l.ellipses, 0) AS ellipses
  FROM words w LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR word_chars / greatest(n_words, 1) NOT BETWEEN 2.0 AND 15.0
            OR n_dup_lines * 10 > n_lines * 3
            OR length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) / greatest(word_chars, 1) < 0.6
            OR length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) / greatest(word_chars, 1) > 0.5
            OR ellipses * 10 > n_lines * 3) AS kept
FROM judged
"""
