"""Name normalisation and trigram similarity, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base letters and the accented forms that stand for them.
ACCENTS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậ", "e": "èéẻẽẹêềếểễệ", "i": "ìíỉĩị", "o": "òóỏõọôồốổỗộơờớởỡợ",
    "u": "ùúủũụưừứửữự", "y": "ỳýỷỹỵ", "d": "đ",
}


def normalized(name: Column) -> Column:
    """Lower case without accents, runs of white space as one blank; null and blank give the empty text."""
    accented, plain = "".join(ACCENTS.values()), "".join(k * len(v) for k, v in ACCENTS.items())
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(name, F.lit(""))), accented, plain), "\\s+", " "))


def normalized_sql(name: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower(coalesce({name}, ''))), 'đ', 'd'), '\\s+', ' ', 'g'))"


def trigrams(name: Column) -> Column:
    """Different trigrams of the words, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))))


def trigrams_sql(name: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({name}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform(list_transform({words}, lambda w: '  ' || w || ' '), lambda p: list_transform(range(1, length(p) - 1), lambda i: p[i:i + 2]))))"


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"
