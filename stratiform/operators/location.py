"""Names of places: a cascade of exact and similar matches, and the similarity join below it.

Two texts are similar by their trigrams (shared over all). Pairs at `limit` or above are found by a set-similarity join:
grams are put in order of rarity among the names, and a set's first n - ceil(limit * n) + 1 grams must meet the other's, or they
share too few; sizes must allow the similarity, too. Common grams stand last, so few pairs meet by one. The pairs that meet
are then compared exactly.

A hint is resolved by phases, of which the first that finds anything counts:

* regions: the name of one, or any hint where the scope is `city`;
* groups: the whole name with its prefix, the name's last words, up to three similar names;
* leaves: "leaf, group" exactly, up to three similar leaves of that group; the name, then the name with a prefix before it; up to
  five similar names, with and without prefixes.

Without a scope a prefix decides where to look first, then groups go before leaves, and a name of both is marked. Several
similar names give `multiple` and all of them, none gives `not_found`. Names are compared in lower case without accents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions import text
from stratiform.registry import query
from stratiform.sources.roles import table

# Prefixes of leaves and groups, in the order in which they are tried, and the similarities that count.
WARD_PREFIXES, DISTRICT_PREFIXES = ("phuong", "xa"), ("quan", "huyen")
LIMIT, LOOSE = 0.5, 0.3
MOST_DISTRICTS, MOST_WARDS, MOST_IN_DISTRICT, MOST_FOUND = 3, 5, 3, 10


def similar(asked: DataFrame, names: DataFrame, limit: float) -> DataFrame:
    """(term, name, score) of every pair of a different `term` of `asked` and a different `name` of `names` with a similarity of
    `limit` (above 0) or more."""
    sides = [df.select(F.col(c).alias("own")).where("own IS NOT NULL").distinct().withColumn("grams", text.trigrams(F.col("own"))) for df, c in ((asked, "term"), (names, "name"))]
    counted = sides[1].select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(sets: DataFrame) -> DataFrame:
        each = sets.select("own", "grams", F.explode("grams").alias("gram")).join(counted, "gram", "left")
        ordered = each.groupBy("own").agg(F.first("grams").alias("grams"), F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("rare"))
        size = F.size("rare")
        return ordered.select("own", "grams", F.explode(F.slice("rare.gram", 1, (size - F.ceil(limit * size - 1e-9) + 1).cast("int"))).alias("gram"))

    left, right = (prefixes(df).withColumnsRenamed({"own": name, "grams": f"{name}_grams"}) for df, name in zip(sides, ("term", "name"), strict=True))
    a, b = F.size("term_grams"), F.size("name_grams")
    met = left.join(right, "gram").where((F.least(a, b) >= limit * F.greatest(a, b) - 1e-9)).groupBy("term", "name").agg(F.first("term_grams").alias("x"), F.first("name_grams").alias("y"))
    return met.select("term", "name", text.similarity(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= limit)


def _starts(name: str | Column, prefixes: tuple[str, ...]) -> Column:
    return (F.col(name) if isinstance(name, str) else name).rlike(f"^({'|'.join(prefixes)}) ")


def core(name: str | Column) -> Column:
    """A normalised name without its prefix."""
    return F.regexp_replace(name, f"^({'|'.join(WARD_PREFIXES + DISTRICT_PREFIXES)}) ", "")


def parts(norm: str | Column) -> tuple[Column, Column]:
    """(leaf, group) of a normalised "leaf, group", split at the first comma; null where a part is missing."""
    norm = F.col(norm) if isinstance(norm, str) else norm
    pair = [F.trim(F.regexp_extract(norm, "^([^,]*),(.*)$", k)) for k in (1, 2)]
    both = norm.contains(",") & (pair[0] != "") & (pair[1] != "")
    return F.when(both, pair[0]), F.when(both, pair[1])


def _with(prefixes: tuple[str, ...], name: str) -> Column:
    return F.array(F.col(name), *[F.concat(F.lit(f"{p} "), F.col(name)) for p in prefixes])


def _first(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def _searched(norms: DataFrame, wards: DataFrame, districts: DataFrame) -> DataFrame:
    """(norm, search, phase, status, found): what the searches of groups (`d`) and leaves (`w`) give for each name, the places
    best first. `norms` holds (norm, leaf, ward_part, district_part), `leaf` being what is looked for among leaves."""
    made = ["norm", F.lit("d").alias("search"), "phase", "exact", "ord", "place_id", "score"]
    of = lambda search, phase, exact, ord, id, score: ["norm", F.lit(search).alias("search"), F.lit(phase).alias("phase"), F.lit(exact).alias("exact"), ord.alias("ord"), F.col(id).alias("place_id"), score.alias("score")]  # noqa: E731, A006
    one, words = F.lit(1.0), F.split("district_name", " ")
    ends = districts.select("district_id", "district_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).alias("norm"))
    whole = _starts("norm", DISTRICT_PREFIXES) & (F.col("norm") == F.col("district_name"))
    groups = norms.select("norm").join(ends, "norm").select("norm", made[1], F.when(whole, 1).otherwise(2).alias("phase"), F.lit(True).alias("exact"), F.lit(0.0).alias("ord"), F.col("district_id").alias("place_id"), one.alias("score"))
    near = similar(norms.select(F.col("norm").alias("term")), districts.select(F.col("district_name").alias("name")), LIMIT).withColumnRenamed("term", "norm")
    groups_near = near.join(districts, F.col("name") == F.col("district_name")).select(*of("d", 3, False, -F.col("score"), "district_id", F.col("score")))

    both = norms.where("ward_part IS NOT NULL")
    spelt = both.select("norm", F.posexplode(_with(WARD_PREFIXES, "ward_part")).alias("i", "ward_name"), "district_part").select("norm", "i", "ward_name", F.posexplode(_with(DISTRICT_PREFIXES, "district_part")).alias("j", "district_name"))
    in_group = _first(wards, ["ward_name", "district_name"], ["ward_id"], MOST_IN_DISTRICT)
    scoped = spelt.join(in_group, ["ward_name", "district_name"]).select(*of("w", 1, True, (F.col("i") * 3 + F.col("j")).cast("double"), "ward_id", one))
    loose = similar(both.select(F.col("ward_part").alias("term")), wards.select(F.col("ward_name").alias("name")), LOOSE)
    there = both.select("norm", F.col("ward_part").alias("term"), F.explode(_with(DISTRICT_PREFIXES, "district_part")).alias("district_name")).join(loose, "term")
    scoped_near = there.join(in_group.withColumnRenamed("ward_name", "name"), ["name", "district_name"]).select(*of("w", 2, False, -F.col("score"), "ward_id", F.col("score")))

    tried = F.when(_starts("leaf", WARD_PREFIXES), F.array("leaf")).otherwise(_with(WARD_PREFIXES, "leaf"))
    terms = norms.select("norm", F.posexplode(tried).alias("i", "term"))
    by_name = _first(wards, ["ward_name"], ["ward_id"], MOST_WARDS)
    leaves = terms.join(by_name, F.col("term") == F.col("ward_name")).select(*of("w", 3, True, F.col("i").cast("double"), "ward_id", one))
    alike = terms.join(similar(terms, wards.select(F.col("ward_name").alias("name")), LIMIT), "term").join(by_name, F.col("name") == F.col("ward_name"))
    leaves_near = alike.groupBy("norm", "ward_id").agg(F.max("score").alias("score")).select(*of("w", 4, False, -F.col("score"), "ward_id", F.col("score")))

    found = reduce(DataFrame.unionByName, (groups, groups_near, scoped, scoped_near, leaves, leaves_near))
    best = Window.partitionBy("norm", "search").orderBy("phase", "ord", "place_id")
    most = F.when(F.col("exact"), 1).when((F.col("search") == "w") & (F.col("phase") == 4), MOST_WARDS).otherwise(MOST_IN_DISTRICT)
    kept = found.withColumns({"nth": F.row_number().over(best), "least": F.min("phase").over(best)}).where((F.col("phase") == F.col("least")) & (F.col("nth") <= most))
    status = F.when(F.first("exact"), "exact").when(F.count(F.lit(1)) > 1, "multiple").otherwise("fuzzy")
    return kept.groupBy("norm", "search").agg(F.first("phase").alias("phase"), status.alias("status"), F.sort_array(F.collect_list(F.struct("nth", "place_id", "score"))).alias("found"))


def resolve(hints: DataFrame, wards: DataFrame, districts: DataFrame, cities: DataFrame, home: int | None = None) -> DataFrame:
    """(hint, scope, status, level, place_id, score, candidates, collision) of each different (hint, scope).

    `wards` holds (ward_id, ward_name, district_id), `districts` (district_id, district_name), `cities` (city_id, city_name);
    `home` is the region of a hint that names none where the scope is `city`. A null or blank hint is not found.
    """
    place = lambda df, id, name: df.select(F.col(id).cast("long").alias(id), text.normalized(F.col(name)).alias(name), *[c for c in df.columns if c not in (id, name)])  # noqa: E731, A006
    districts, cities = place(districts, "district_id", "district_name"), place(cities, "city_id", "city_name")
    wards = place(wards, "ward_id", "ward_name").join(districts, "district_id", "left").select("ward_id", "ward_name", "district_name")
    asked = hints.select("hint", "scope").distinct().withColumn("norm", text.normalized(F.col("hint")))
    leaf, group = parts("norm")
    norms = asked.where("norm <> ''").select("norm").distinct().withColumns({"ward_part": leaf, "district_part": group}).withColumn("leaf", F.coalesce("ward_part", "norm"))
    found = _searched(norms, wards, districts)
    side = lambda s: found.where(F.col("search") == s).select("norm", F.struct("status", "found", "phase").alias(s))
    named = cities.groupBy(F.col("city_name").alias("norm")).agg(F.min("city_id").alias("city_id"))
    twice = districts.select(core("district_name").alias("norm")).intersect(wards.select(core("ward_name").alias("norm"))).withColumn("twice", F.lit(True))
    rows = asked.join(side("d"), "norm", "left").join(side("w"), "norm", "left").join(named, "norm", "left").join(twice, "norm", "left")
    sure = lambda s: F.coalesce(F.col(f"{s}.status").isin("exact", "fuzzy"), F.lit(False))
    use = (
        F.when(F.col("city_id").isNotNull() | F.col("scope").eqNullSafe("city"), "city").when(F.col("scope") == "district", "district").when(F.col("scope") == "ward", "ward")
        .when(_starts("norm", WARD_PREFIXES) & sure("w"), "ward").when(sure("d"), "district").otherwise("ward")
    )
    own = F.when(F.col("use") == "district", F.col("d")).otherwise(F.col("w"))
    picked = rows.withColumn("use", use).withColumn("own", F.when(F.col("use") != "city", own))
    status = F.when(F.col("use") == "city", "exact").otherwise(F.coalesce("own.status", F.lit("not_found")))
    best, alone = F.col("own.found")[0], F.col("status").isin("exact", "fuzzy")
    return picked.withColumn("status", status).select(
        "hint", "scope", "status", F.when(F.col("status") == "not_found", "not_found").otherwise(F.col("use")).alias("level"),
        F.when(F.col("use") == "city", F.coalesce("city_id", F.lit(home).cast("long"))).when(alone, best["place_id"]).alias("place_id"),
        F.when(F.col("use") == "city", 1.0).otherwise(best["score"]).alias("score"), F.when(F.col("status") == "multiple", F.col("own.found.place_id")).alias("candidates"),
        (F.col("scope").isNull() & (F.col("use") == "district") & F.col("twice").isNotNull()).alias("collision"),
    )


def search(keywords: DataFrame, wards: DataFrame, districts: DataFrame, most: int = MOST_FOUND) -> DataFrame:
    """(keyword, ward_id, score, district_score): the leaves whose own or group's name is like the keyword, by the leaf's score."""
    norms = keywords.select("keyword").distinct().withColumn("term", text.normalized(F.col("keyword")))
    places = wards.select("ward_id", "district_id", text.normalized(F.col("ward_name")).alias("ward_name")).join(districts.select("district_id", text.normalized(F.col("district_name")).alias("district_name")), "district_id")
    own, group = (similar(norms, places.select(F.col(c).alias("name")), LOOSE).withColumnsRenamed({"name": c, "score": score}) for c, score in (("ward_name", "score"), ("district_name", "district_score")))
    # Leaves of one name in one group score alike, as do a group's leaves where only the group is like the keyword, so the
    # `most` of least id of each are enough.
    alike, of_group = _first(places, ["ward_name", "district_name"], ["ward_id"], most), _first(places, ["district_name"], ["ward_id"], most)
    by_own = norms.join(own, "term").join(alike, "ward_name").select("keyword", "term", "ward_id", "ward_name", "district_name")
    by_group = norms.join(group, "term").join(of_group, "district_name").select("keyword", "term", "ward_id", "ward_name", "district_name")
    met = by_own.union(by_group).distinct().join(own, ["term", "ward_name"], "left").join(group, ["term", "district_name"], "left")
    scored = met.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("score", "district_score")})
    return _first(scored, ["keyword"], [F.desc("score"), F.desc("district_score"), "ward_id"], most).select("keyword", "ward_id", "score", "district_score")


# ---------------------------------------------------------------- the driver's tables as a gazetteer


def gazetteer(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wards, districts, cities): nations are groups, and different names of parts in a nation its leaves; some are named as it is."""
    bare = F.translate(F.lower("n_name"), "_", " ")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("district_id"), bare.alias("bare"))
    districts = nations.select("district_id", F.concat(F.when(F.col("district_id") % 2 == 0, "Quận ").otherwise("Huyện "), "bare").alias("district_name"))
    own = F.when(F.col("p_size") % 10 == 0, F.col("bare")).otherwise(F.col("p_name"))
    leaves = table(spark, sf_dir, "part").withColumn("district_id", F.col("p_partkey") % 25).join(nations, "district_id")
    wards = leaves.groupBy("district_id", F.concat(F.when(F.col("p_size") % 2 == 0, "Phường ").otherwise("Xã "), own).alias("ward_name")).agg(F.min("p_partkey").alias("ward_id"))
    cities = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("city_id"), F.col("r_name").alias("city_name"))
    return wards, districts, cities


_GAZETTEER_SQL = """WITH d AS MATERIALIZED (SELECT n_nationkey::BIGINT AS id, replace(lower(n_name), '_', ' ') AS bare, CASE WHEN n_nationkey % 2 = 0 THEN 'quan ' ELSE 'huyen ' END || replace(lower(n_name), '_', ' ') AS name FROM nation),
w AS MATERIALIZED (SELECT min(p_partkey) AS id, name, d_name, d_bare, bare FROM (
  SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN d.bare ELSE p_name END AS bare, CASE WHEN p_size % 2 = 0 THEN 'phuong ' ELSE 'xa ' END || CASE WHEN p_size % 10 = 0 THEN d.bare ELSE p_name END AS name, d.name AS d_name, d.bare AS d_bare
  FROM part JOIN d ON d.id = p_partkey % 25) GROUP BY ALL),
hints AS MATERIALIZED (
  SELECT DISTINCT hint, scope FROM (
    SELECT unnest([name, bare, left(bare, length(bare) - 1), replace(bare, 'i', 'y') || 'x']) AS hint FROM w UNION ALL SELECT unnest([upper(name), bare, left(bare, length(bare) - 1)]) FROM d
    UNION ALL SELECT r_name FROM region UNION ALL SELECT 'nowhere at all'), (SELECT unnest([NULL, 'district', 'ward', 'city']) AS scope)
  UNION SELECT unnest([bare || ', ' || d_bare, left(bare, length(bare) - 2) || ', ' || d_name, bare || ', nowhere']), NULL FROM w)
"""


def hints(spark, sf_dir) -> DataFrame:
    """Names of the gazetteer as they are, bare, cut short and misspelt, with all scopes, and leaves with their groups."""
    wards, districts, cities = gazetteer(spark, sf_dir)
    wards = wards.join(districts, "district_id").select(*[text.normalized(F.col(c)).alias(c) for c in ("ward_name", "district_name")])
    own, group = core("ward_name"), core("district_name")
    cut = lambda c, n: F.left(c, F.length(c) - n)
    plain = wards.select(F.explode(F.array("ward_name", own, cut(own, 1), F.concat(F.translate(own, "i", "y"), F.lit("x")))).alias("hint"))
    plain = plain.union(districts.select(text.normalized(F.col("district_name")).alias("n")).select(F.explode(F.array(F.upper("n"), core("n"), cut(core("n"), 1)))))
    plain = plain.union(cities.select("city_name")).union(spark.range(1).select(F.lit("nowhere at all")))
    scopes = F.array(F.lit(None).cast("string"), *map(F.lit, ("district", "ward", "city")))
    pairs = F.array(F.concat(own, F.lit(", "), group), F.concat(cut(own, 2), F.lit(", "), "district_name"), F.concat(own, F.lit(", nowhere")))
    return plain.select("hint", F.explode(scopes).alias("scope")).union(wards.select(F.explode(pairs).alias("hint"), F.lit(None).cast("string"))).distinct()


def _all_pairs_sql(name: str, terms: str, names: str, limit: float) -> str:
    """Every pair compared, without a filter."""
    return f"""{name} AS MATERIALIZED (SELECT term, name, score FROM (SELECT term, name, {text.similarity_sql('a', 'b')} AS score FROM (SELECT DISTINCT term, {text.trigrams_sql('term')} AS a FROM {terms}), (SELECT DISTINCT name, {text.trigrams_sql('name')} AS b FROM {names})) WHERE score >= {limit})"""


_PREFIXED = lambda column, prefixes: "(" + " OR ".join(f"starts_with({column}, '{p} ')" for p in prefixes) + ")"
_BEFORE = lambda column, prefixes: "[" + ", ".join([column, *[f"'{p} ' || {column}" for p in prefixes]]) + "]"
RESOLVED_SQL = _GAZETTEER_SQL + f""", asked AS (SELECT hint, scope, {text.normalized_sql('hint')} AS norm FROM hints),
n AS MATERIALIZED (
  SELECT norm, CASE WHEN paired THEN trim(split_part(norm, ',', 1)) END AS wp, CASE WHEN paired THEN trim(substr(norm, position(',' IN norm) + 1)) END AS dp, CASE WHEN paired THEN trim(split_part(norm, ',', 1)) ELSE norm END AS leaf
  FROM (SELECT DISTINCT norm, contains(norm, ',') AND trim(split_part(norm, ',', 1)) <> '' AND trim(substr(norm, position(',' IN norm) + 1)) <> '' AS paired FROM asked WHERE norm <> '')),
terms AS MATERIALIZED (SELECT norm, unnest(CASE WHEN {_PREFIXED('leaf', WARD_PREFIXES)} THEN [leaf] ELSE {_BEFORE('leaf', WARD_PREFIXES)} END) AS term, generate_subscripts(CASE WHEN {_PREFIXED('leaf', WARD_PREFIXES)} THEN [leaf] ELSE {_BEFORE('leaf', WARD_PREFIXES)} END, 1) AS i FROM n),
{_all_pairs_sql('sd', '(SELECT norm AS term FROM n)', 'd', LIMIT)}, {_all_pairs_sql('sw', 'terms', 'w', LIMIT)}, {_all_pairs_sql('sl', '(SELECT wp AS term FROM n WHERE wp IS NOT NULL)', 'w', LOOSE)},
c AS (
  SELECT norm, 'd' AS search, CASE WHEN {_PREFIXED('norm', DISTRICT_PREFIXES)} AND norm = name THEN 1 ELSE 2 END AS phase, true AS exact, 0.0::DOUBLE AS ord, id, 1.0::DOUBLE AS score FROM n JOIN d ON norm = name OR ends_with(name, ' ' || norm)
  UNION ALL SELECT term, 'd', 3, false, -score, id, score FROM sd JOIN d USING (name)
  UNION ALL SELECT norm, 'w', 1, true, list_position({_BEFORE('wp', WARD_PREFIXES)}, name) * 3 + list_position({_BEFORE('dp', DISTRICT_PREFIXES)}, d_name), id, 1.0 FROM n JOIN w ON list_contains({_BEFORE('wp', WARD_PREFIXES)}, name) AND list_contains({_BEFORE('dp', DISTRICT_PREFIXES)}, d_name)
  UNION ALL SELECT norm, 'w', 2, false, -score, id, score FROM n JOIN sl ON term = wp JOIN w ON w.name = sl.name AND list_contains({_BEFORE('dp', DISTRICT_PREFIXES)}, d_name)
  UNION ALL SELECT norm, 'w', 3, true, i, id, 1.0 FROM terms JOIN w ON name = term
  UNION ALL SELECT norm, 'w', 4, false, -max(score), id, max(score) FROM terms JOIN sw USING (term) JOIN w USING (name) GROUP BY norm, id),
k AS (SELECT *, row_number() OVER (PARTITION BY norm, search ORDER BY phase, ord, id) AS nth, min(phase) OVER (PARTITION BY norm, search) AS least FROM c),
f AS (
  SELECT norm, search, CASE WHEN bool_or(exact) THEN 'exact' WHEN count(*) > 1 THEN 'multiple' ELSE 'fuzzy' END AS status, list(id ORDER BY nth) AS ids, max(score) AS score
  FROM k WHERE phase = least AND nth <= CASE WHEN exact THEN 1 WHEN phase = 4 THEN {MOST_WARDS} ELSE {MOST_DISTRICTS} END GROUP BY norm, search),
u AS (
  SELECT a.*, r_regionkey::BIGINT AS city_id, fd.status AS ds, fd.ids AS di, fd.score AS dsc, fw.status AS ws, fw.ids AS wi, fw.score AS wsc,
    CASE WHEN r_regionkey IS NOT NULL OR scope = 'city' THEN 'city' WHEN scope IN ('district', 'ward') THEN scope WHEN {_PREFIXED('a.norm', WARD_PREFIXES)} AND fw.status IN ('exact', 'fuzzy') THEN 'ward' WHEN fd.status IN ('exact', 'fuzzy') THEN 'district' ELSE 'ward' END AS used
  FROM asked a LEFT JOIN f fd ON fd.norm = a.norm AND fd.search = 'd' LEFT JOIN f fw ON fw.norm = a.norm AND fw.search = 'w' LEFT JOIN region ON lower(r_name) = a.norm),
o AS (SELECT hint, scope, norm, used, city_id, CASE used WHEN 'city' THEN 'exact' WHEN 'district' THEN coalesce(ds, 'not_found') ELSE coalesce(ws, 'not_found') END AS status, CASE used WHEN 'district' THEN di WHEN 'ward' THEN wi END AS ids, CASE used WHEN 'city' THEN 1.0::DOUBLE WHEN 'district' THEN dsc ELSE wsc END AS score FROM u),
resolved AS (
  SELECT hint, scope, status, CASE WHEN status = 'not_found' THEN status ELSE used END AS level, CASE WHEN used = 'city' THEN coalesce(city_id, 0) WHEN status IN ('exact', 'fuzzy') THEN ids[1] END AS place_id, score,
    CASE WHEN status = 'multiple' THEN ids END AS candidates, scope IS NULL AND used = 'district' AND norm IN (SELECT bare FROM d INTERSECT SELECT bare FROM w) AS collision FROM o)
"""


def _resolved(spark, sf_dir) -> DataFrame:
    return resolve(hints(spark, sf_dir), *gazetteer(spark, sf_dir), home=0)


@query(RESOLVED_SQL + "SELECT hint, scope, status, level, place_id, round(score, 9) AS score, array_to_string(candidates, ',') AS candidates, collision FROM resolved")
def str_resolve_location(spark, sf_dir):
    """All hints with all scopes."""
    return _resolved(spark, sf_dir).withColumns({"score": F.round("score", 9), "candidates": F.array_join(F.col("candidates").cast("array<string>"), ",")})


@query(RESOLVED_SQL + "SELECT hint, status, level, place_id, round(score, 9) AS score FROM resolved WHERE scope IS NULL")
def resolve_location(spark, sf_dir):
    """The tool: a hint without a scope."""
    found = resolve(hints(spark, sf_dir).where("scope IS NULL"), *gazetteer(spark, sf_dir), home=0)
    return found.select("hint", "status", "level", "place_id", F.round("score", 9).alias("score"))


def auto_resolve(asked: DataFrame, wards: DataFrame, districts: DataFrame, cities: DataFrame, home: int | None = None) -> DataFrame:
    """(ward_id, hint, scope, status, level, place_id, candidates): a leaf by its id where that is known, else by the cascade; several
    candidates ask for clarification, and neither id nor hint is an error."""
    by_id = asked.join(wards.select(F.col("ward_id").alias("known")).distinct(), F.col("ward_id") == F.col("known"), "left")
    named = resolve(asked.select("hint", "scope").where("hint IS NOT NULL"), wards, districts, cities, home)
    rows = by_id.alias("a").join(named.alias("b"), F.col("a.hint").eqNullSafe(F.col("b.hint")) & F.col("a.scope").eqNullSafe(F.col("b.scope")), "left")
    there = F.col("known").isNotNull()
    asks = F.when(F.col("b.status") == "multiple", "needs_clarification").otherwise(F.coalesce("b.status", F.lit("error")))
    return rows.select(
        "a.ward_id", "a.hint", "a.scope", F.when(there, "exact").otherwise(asks).alias("status"), F.when(there, "ward").otherwise(F.col("b.level")).alias("level"),
        F.when(there, F.col("known")).otherwise(F.col("b.place_id")).alias("place_id"), F.when(~there, F.col("b.candidates")).alias("candidates"),
    )


@query(RESOLVED_SQL + """, requests AS (SELECT CASE WHEN length(hint) % 3 = 0 THEN length(hint) * 7 END::BIGINT AS ward_id, CASE WHEN length(hint) % 5 <> 0 THEN hint END AS hint, scope FROM hints)
SELECT DISTINCT q.ward_id, q.hint, q.scope, CASE WHEN w.id IS NOT NULL THEN 'exact' WHEN r.status = 'multiple' THEN 'needs_clarification' ELSE coalesce(r.status, 'error') END AS status, CASE WHEN w.id IS NOT NULL THEN 'ward' ELSE r.level END AS level,
  coalesce(w.id, r.place_id) AS place_id, CASE WHEN w.id IS NULL THEN array_to_string(r.candidates, ',') END AS candidates
FROM requests q LEFT JOIN w ON w.id = q.ward_id LEFT JOIN resolved r ON r.hint IS NOT DISTINCT FROM q.hint AND r.scope IS NOT DISTINCT FROM q.scope""")
def disp_auto_resolve(spark, sf_dir):
    """Requests with an id, a hint, both or neither, made of the hints by their lengths."""
    n = F.length("hint")
    asked = hints(spark, sf_dir).select(F.when(n % 3 == 0, n * 7).cast("long").alias("ward_id"), F.when(n % 5 != 0, F.col("hint")).alias("hint"), "scope").distinct()
    return auto_resolve(asked, *gazetteer(spark, sf_dir), home=0).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query(_GAZETTEER_SQL + f""", p AS (SELECT DISTINCT hint, {text.normalized_sql('hint')} AS norm FROM hints)
SELECT hint, regexp_extract(norm, '^(phuong|xa|quan|huyen) ', 1) AS prefix, regexp_replace(norm, '^(phuong|xa|quan|huyen) ', '') AS core,
  CASE WHEN regexp_matches(norm, '^(phuong|xa) ') THEN 'ward' WHEN regexp_matches(norm, '^(quan|huyen) ') THEN 'district' END AS kind,
  CASE WHEN contains(norm, ',') THEN trim(split_part(norm, ',', 1)) END AS ward_part, CASE WHEN contains(norm, ',') THEN trim(substr(norm, position(',' IN norm) + 1)) END AS district_part FROM p""")
def str_prefix_strip(spark, sf_dir):
    """What a name's prefix says of its level, the name without it, and both parts of "leaf, group"."""
    rows = hints(spark, sf_dir).select("hint").distinct().withColumn("norm", text.normalized(F.col("hint")))
    leaf, group = parts("norm")
    prefix = F.regexp_extract("norm", f"^({'|'.join(WARD_PREFIXES + DISTRICT_PREFIXES)}) ", 1)
    kind = F.when(_starts("norm", WARD_PREFIXES), "ward").when(_starts("norm", DISTRICT_PREFIXES), "district")
    return rows.select("hint", prefix.alias("prefix"), core("norm").alias("core"), kind.alias("kind"), leaf.alias("ward_part"), group.alias("district_part"))


@query(_GAZETTEER_SQL + f""", q AS (SELECT DISTINCT hint AS keyword, {text.normalized_sql('hint')} AS term FROM hints WHERE scope = 'ward'),
{_all_pairs_sql('sw', 'q', 'w', 0)}, {_all_pairs_sql('sd', 'q', 'd', 0)},
s AS (SELECT keyword, w.id AS ward_id, CASE WHEN sw.score >= {LOOSE} THEN sw.score ELSE 0 END AS score, CASE WHEN sd.score >= {LOOSE} THEN sd.score ELSE 0 END AS district_score FROM q JOIN sw USING (term) JOIN w USING (name) JOIN sd ON sd.term = q.term AND sd.name = w.d_name WHERE sw.score >= {LOOSE} OR sd.score >= {LOOSE})
SELECT keyword, ward_id, round(score, 9) AS score, round(district_score, 9) AS district_score FROM s QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY score DESC, district_score DESC, ward_id) <= {MOST_FOUND}""")
def str_search_wards(spark, sf_dir):
    """For each keyword the ten leaves whose own or group's name is most like it."""
    wards, districts, _ = gazetteer(spark, sf_dir)
    keywords = hints(spark, sf_dir).where("scope = 'ward'").select(F.col("hint").alias("keyword"))
    return search(keywords, wards, districts).withColumns({c: F.round(c, 9) for c in ("score", "district_score")})


def candidates(norms: DataFrame, wards: DataFrame, most: int = MOST_WARDS) -> DataFrame:
    """(norm, ward_id, score): the leaves most like a name in any of its spellings, each once with its best score."""
    names = wards.select("ward_id", text.normalized(F.col("ward_name")).alias("ward_name"))
    tried = F.when(_starts("norm", WARD_PREFIXES), F.array("norm")).otherwise(_with(WARD_PREFIXES, "norm"))
    terms = norms.select("norm").distinct().select("norm", F.explode(tried).alias("term"))
    alike = terms.join(similar(terms, names.select(F.col("ward_name").alias("name")), LIMIT), "term").join(_first(names, ["ward_name"], ["ward_id"], most), F.col("name") == F.col("ward_name"))
    best = alike.groupBy("norm", "ward_id").agg(F.max("score").alias("score"))
    return _first(best, ["norm"], [F.desc("score"), "ward_id"], most)


@query(_GAZETTEER_SQL + f""", n AS (SELECT DISTINCT {text.normalized_sql('hint')} AS norm FROM hints WHERE scope = 'ward'), terms AS MATERIALIZED (SELECT norm, unnest(CASE WHEN {_PREFIXED('norm', WARD_PREFIXES)} THEN [norm] ELSE {_BEFORE('norm', WARD_PREFIXES)} END) AS term FROM n),
{_all_pairs_sql('sw', 'terms', 'w', LIMIT)}, b AS (SELECT norm, id AS ward_id, max(score) AS score FROM terms JOIN sw USING (term) JOIN w USING (name) GROUP BY ALL)
SELECT norm, ward_id, round(score, 9) AS score FROM b QUALIFY row_number() OVER (PARTITION BY norm ORDER BY score DESC, ward_id) <= {MOST_WARDS}""")
def set_union_candidates(spark, sf_dir):
    """Candidates of all spellings of each name."""
    norms = hints(spark, sf_dir).where("scope = 'ward'").select(text.normalized(F.col("hint")).alias("norm"))
    return candidates(norms, gazetteer(spark, sf_dir)[0]).withColumn("score", F.round("score", 9))
