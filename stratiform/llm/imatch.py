"""Document fingerprints by I-Match, in DataFrame expressions only.

Terms are runs of letters and digits in lower case. The lexicon holds the terms whose inverse document frequency lies in a
band: neither those that most texts have nor those that few have. As a term of the band is in one of `MOST` texts at least, the
lexicon has at most `MOST` times as many terms as a text has different terms on average, however many texts there are;
that bounds its broadcast.

The first code of a fingerprint hashes all distinct terms of the text that are in the lexicon, sorted. The others hash
those in random subsets of the lexicon. There are `SUBSETS` families of subsets, each halved again and again (a term's hash says
how deep it goes in each), and a family's code is taken on the sparsest subset that still has a term of the text: a long text is
judged by a small subset as a short one is by a large. Two texts' likeness is the share of their codes that are equal, near
1/3 to 1/2 where two thirds of a text stay, 0 for strangers.

For the edits, texts meet their next one in the order of ids: they are dealt by chunks of neighbouring ids, with a copy of the
next chunk's first row at the end of each, and from there on nothing is dealt anew.

Defined results: a null text is the empty text; a text without a term of the lexicon has the hash of the whole text for each
code; rows of equal ids stand in the order of their texts' hashes, rows without an id come last; ids are whole numbers (others
are refused); a single row is its own next; other columns are not read; an empty table gives an empty result. Rows of one
id, other than null, meet in one task, which spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from stratiform.llm.common import written

#: The band: terms that are in one of so many texts at most, and in one of so many at least; idf is the logarithm of these.
LEAST, MOST = 10, 1000
#: Families of random subsets of the lexicon; each code has so many hex digits.
SUBSETS, DIGITS = 15, 8
#: Rows of a chunk at least, chunks at most, and the quantiles of the ids between which chunks are of equal width.
CHUNK_ROWS, MAX_CHUNKS, QUANTILES = 64, 1 << 18, 256


def terms(text: str | Column) -> Column:
    """The distinct terms of a text, the empty one among them."""
    return F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"))


def lexicon(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term hash, code, depths) of the terms in the band; `depths` holds four bits for each family."""
    texts = df.select(F.coalesce(text_col, F.lit("")).alias("text"))
    n = texts.count()
    counted = texts.select(F.explode(terms("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counted.where((F.col("term") != "") & (F.col("df") * LEAST <= n) & (F.col("df") * MOST >= n)).withColumn("sha", F.sha2("term", 256))
    depth = [F.lit(16) - F.length(F.conv(F.substring("sha", 4 * r + 5, 4), 16, 2)) for r in range(SUBSETS)]
    depths = sum((F.shiftleft(d.cast("long"), 4 * r) for r, d in enumerate(depth)), F.lit(0).cast("long"))
    return written(band.select(F.xxhash64("term").alias("h"), F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("code"), depths.alias("depths")), "lexicon")


def _hashed(values: Column) -> Column:
    return F.substring(F.md5(F.array_join(values.cast("array<string>"), " ")), 1, DIGITS)


def _sparsest(own: Column, r: int) -> Column:
    """Those of the terms that go as deep as any in family `r`."""

    def depth(x: Column) -> Column:
        return F.shiftright(x["depths"], 4 * r).bitwiseAND(15)

    # The array of one element binds the greatest depth, which the filter would compute for each term otherwise.
    most = F.array(F.array_max(F.transform(own, depth)))
    return F.element_at(F.transform(most, lambda top: F.filter(own, lambda x: depth(x) == top)), 1)


def codes(own: Column, whole: Column) -> Column:
    """The fingerprint of an array of (code, depths) sorted by code, or where it is empty of the hash `whole`."""
    parts = [_hashed(own["code"]), *[_hashed(_sparsest(own, r)["code"]) for r in range(SUBSETS)]]
    return F.when(F.size(own) == 0, F.repeat(F.substring(whole, 1, DIGITS), SUBSETS + 1)).otherwise(F.concat(*parts))


def fingerprints(df: DataFrame, words: DataFrame, keys: list[str], keep: list[str], text_col: str = "text") -> DataFrame:
    """(`keys`, `keep`, fingerprint) of each row; `keys` tells rows apart, `words` comes from `lexicon`.

    Terms meet the lexicon's broadcast where the text is. Rows stay in their partitions if these go by columns of `keys`.
    """
    # The first element is no term: it carries the row's other columns and holds the place of a row without terms.
    hashes = F.concat(F.array(F.lit(None).cast("long")), F.transform(terms(text_col), lambda t: F.xxhash64(t)))
    each = df.select(*keys, F.struct(*keep, F.md5(F.col(text_col)).alias("__whole")).alias("__row"), F.posexplode(hashes).alias("__at", "__term"))
    met = each.join(F.broadcast(words), F.col("__term") == F.col("h"), "left").where("code IS NOT NULL OR __at = 0")
    found = met.select(*keys, F.when(F.col("__at") == 0, F.col("__row")).alias("__row"), F.when(F.col("code").isNotNull(), F.struct("code", "depths")).alias("__own"))
    out = found.groupBy(*keys).agg(F.first("__row", ignorenulls=True).alias("__row"), F.sort_array(F.collect_list("__own")).alias("__own"))
    return out.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in keep], codes(F.col("__own"), F.col("__row.__whole")).alias("fingerprint"))


def likeness(a: str | Column, b: str | Column) -> Column:
    """The share of equal codes."""
    at = F.sequence(F.lit(0), F.lit(SUBSETS))
    part = lambda text, i: F.substr(F.col(text) if isinstance(text, str) else text, i * DIGITS + 1, F.lit(DIGITS))
    return F.size(F.filter(at, lambda i: part(a, i) == part(b, i))) / F.lit(float(SUBSETS + 1))


def _chunk(rows: DataFrame) -> Column:
    """The chunk of a row (id, tag): a number that does not fall as ids grow, below 0 where there is none."""
    n, nulls, most = rows.agg(F.count("id"), F.count_if(F.col("id").isNull()), F.max("id")).first()
    cuts = rows.agg(F.percentile_approx("id", [i / QUANTILES for i in range(QUANTILES)], 100 * QUANTILES)).first()[0] or []
    cuts = sorted(set(cuts))
    per = max(CHUNK_ROWS, -(-(n + nulls) // MAX_CHUNKS))
    parts = max(1, -(-n // (QUANTILES * per)))
    # Null ids stand in the order of their tags, which are spread evenly.
    bare_parts = max(1, -(-nulls // per))
    bare = -1 - F.least(F.floor((F.col("tag").cast("double") + 2.0**63) / 2.0**64 * bare_parts), F.lit(bare_parts - 1))
    if not cuts:
        return bare.cast("long")
    lows, widths = F.array(*map(F.lit, map(float, cuts))), F.array(*[F.lit(float(b) - float(a) + 1) for a, b in zip(cuts, [*cuts[1:], most], strict=True)])
    own = F.greatest(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("id"))), F.lit(1))
    within = F.floor((F.col("id").cast("double") - F.element_at(lows, own)) / F.element_at(widths, own) * parts)
    place = own.cast("long") * parts + F.least(F.greatest(within, F.lit(0)), F.lit(parts - 1))
    return F.when(F.col("id").isNull(), bare).otherwise(place).cast("long")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, place, id, text, next_text, ghost): rows with the text of the row that follows in descending order of ids, the
    last one's being the first. The last row of each chunk, a ghost, is a copy of the row that follows the chunk."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    rows = rows.withColumn("chunk", _chunk(rows))
    # The first row of each chunk: the greatest id, and of equal ones the least tag. At most MAX_CHUNKS rows and some.
    best = F.max(F.struct("id", F.bitwise_not("tag").alias("tag")))
    firsts = written(rows.groupBy("chunk").agg(best.alias("best")).select("chunk", "best.id", F.bitwise_not("best.tag").alias("tag")), "firsts")
    down = Window.orderBy(F.col("chunk").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(down), F.first(c).over(whole))
    ends = firsts.select("chunk", after(F.struct("id", "tag")).alias("after")).select(F.col("chunk").alias("into"), F.col("after.id").alias("own_id"), F.col("after.tag").alias("own_tag"))
    ghosts = rows.join(F.broadcast(ends), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("tag") == F.col("own_tag"))).select("id", "text", "tag", F.col("into").alias("chunk"), F.lit(True).alias("ghost"))
    both = rows.select("id", "text", "tag", "chunk", F.lit(False).alias("ghost")).unionByName(ghosts)
    order = Window.partitionBy("chunk").orderBy("ghost", F.col("id").desc_nulls_last(), "tag")
    return both.select("chunk", F.row_number().over(order).alias("place"), "id", "text", F.lead("text").over(order).alias("next_text"), "ghost")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against itself with
    its last third replaced by the beginning of the next text, and against that text."""
    rows = with_next(df, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("cut")), F.left(F.coalesce("next_text", F.lit("")), F.col("cut")))
    sides = rows.select("chunk", "place", "id", "ghost", "n_chars", F.posexplode(F.array("text", edited)).alias("side", "text"))
    sides = sides.withColumn("sha256", F.when(F.col("side") == 1, F.sha2("text", 256)))
    prints = fingerprints(sides, lexicon(df, text_col), ["chunk", "place", "side"], ["id", "ghost", "n_chars", "sha256"])
    order = Window.partitionBy("chunk").orderBy("place", "side")
    near = prints.select("*", *[F.lead(c, by).over(order).alias(name) for name, c, by in (("edited_sha256", "sha256", 1), ("edited_fingerprint", "fingerprint", 1), ("next_fingerprint", "fingerprint", 2))])
    out = near.where("side = 0 AND NOT ghost")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nexts AS (
  SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(doc_id) OVER w, first(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id, coalesce(lead(text) OVER w, first(text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM texts WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (SELECT *, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) AS edited FROM nexts),
sides AS (SELECT doc_id, 0 AS side, text FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
terms AS MATERIALIZED (SELECT doc_id, side, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'))) AS term FROM sides),
lexicon AS MATERIALIZED (
  SELECT term, sha256(term) AS sha FROM terms WHERE side = 0 AND term <> '' GROUP BY term
  HAVING count(*) * {LEAST} <= (SELECT count(*) FROM texts) AND count(*) * {MOST} >= (SELECT count(*) FROM texts)),
coded AS MATERIALIZED (
  SELECT term, ('0x' || substr(sha, 1, 15))::BIGINT AS code, list_transform(range({SUBSETS}), lambda r: 16 - length(bin(('0x' || substr(sha, 4 * r + 5, 4))::BIGINT))) AS depths FROM lexicon),
owned AS MATERIALIZED (SELECT doc_id, side, code, depths FROM terms JOIN coded USING (term)),
wholes AS (SELECT doc_id, side, 0 AS k, string_agg(code::VARCHAR, ' ' ORDER BY code) AS picked FROM owned GROUP BY ALL),
deep AS (SELECT doc_id, side, r + 1 AS k, code, depths[r + 1] AS depth, max(depths[r + 1]) OVER (PARTITION BY doc_id, side, r) AS most FROM owned, range({SUBSETS}) AS x(r)),
parts AS (SELECT * FROM wholes UNION ALL SELECT doc_id, side, k, string_agg(code::VARCHAR, ' ' ORDER BY code) FROM deep WHERE depth = most GROUP BY doc_id, side, k),
joined AS (SELECT doc_id, side, string_agg(substr(md5(picked), 1, {DIGITS}), '' ORDER BY k) AS fp FROM parts GROUP BY doc_id, side),
prints AS MATERIALIZED (SELECT doc_id, side, coalesce(fp, repeat(substr(md5(text), 1, {DIGITS}), {SUBSETS + 1})) AS fp FROM sides LEFT JOIN joined USING (doc_id, side))
SELECT e.doc_id, e.n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  len(list_filter(range({SUBSETS + 1}), lambda i: substr(a.fp, i * {DIGITS} + 1, {DIGITS}) = substr(b.fp, i * {DIGITS} + 1, {DIGITS}))) / {SUBSETS + 1}.0::DOUBLE AS near_edited,
  len(list_filter(range({SUBSETS + 1}), lambda i: substr(a.fp, i * {DIGITS} + 1, {DIGITS}) = substr(c.fp, i * {DIGITS} + 1, {DIGITS}))) / {SUBSETS + 1}.0::DOUBLE AS near_next
FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.side = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.side = 1 JOIN prints c ON c.doc_id = e.next_id AND c.side = 0
"""
