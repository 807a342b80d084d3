"""Point-in-time snapshots: filters by time, latest rows, rankings, comparisons, look-ups, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions import text
from stratiform.operators.rollup import _daily_sql, _hourly_sql, agg_city_daily, group_hours
from stratiform.registry import REGISTRY, query
from stratiform.sources.roles import AS_OF, HOURLY_SQL, NEXT_DAY, NEXT_HOUR, TWO_HOURS_AGO, as_of, cities, civil, districts, hourly, latest_of, observations, placed, rounded, shown, table, wards

NOW = f"TIMESTAMP '{AS_OF}'"
TS = "strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc"


def _filtered(name: str, condition: str, sql_condition: str | None = None, since: str | None = None, until: str | None = None) -> None:
    """Registers a filter of the hourly facts; the condition is SQL in both engines, the bounds what it implies for the scan."""

    def run(spark, sf_dir):
        return hourly(spark, sf_dir, since, until).where(condition).select("ward_id", shown("ts_utc").alias("ts_utc"), "temp", "data_kind", "weather_main")

    run.__name__, run.__doc__ = name, f"Hourly facts where {condition}."
    query(HOURLY_SQL + f"SELECT ward_id, {TS}, temp, data_kind, weather_main FROM hourly WHERE {sql_condition or condition}")(run)


_filtered("flt_eq", "ward_id = 7 AND data_kind = 'forecast'", since=AS_OF)
_filtered("flt_fresh_2h", f"ts_utc > {NOW} - INTERVAL 2 HOURS AND ts_utc <= {NOW} + INTERVAL 30 MINUTES", since=TWO_HOURS_AGO, until=NEXT_HOUR)
_filtered("flt_next24h", f"ts_utc > {NOW} AND ts_utc < {NOW} + INTERVAL 24 HOURS", since=NEXT_HOUR, until=NEXT_DAY)
_filtered("flt_between_dates", "CAST(ts_utc AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'", since="2024-01-10 00:00:00", until="2024-01-13 00:00:00")
_filtered("flt_in_list", "data_kind IN ('forecast', 'history') AND ward_id IN (1, 2, 3, 5, 8)")
_filtered("flt_not_null", "temp IS NOT NULL AND weather_main IS NOT NULL AND data_kind = 'current'", since="2024-01-19 06:00:00", until=NEXT_HOUR)
_filtered("flt_civil_day", "to_date(ts_utc + INTERVAL 7 HOURS) = DATE '2024-01-20'", "(ts_utc + INTERVAL 7 HOURS)::DATE = DATE '2024-01-20'", since="2024-01-19 17:00:00", until="2024-01-20 17:00:00")


def future(facts: DataFrame, key: str, n: int, cap: int = 48) -> DataFrame:
    """The first `n` rows (1 to `cap`) after the reference instant, for each key."""
    n = max(1, min(n, cap))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("ts_utc"))
    return facts.where(F.col("ts_utc") > as_of()).withColumn("nth", nth).where(F.col("nth") <= n)


@query(HOURLY_SQL + f"SELECT ward_id, {TS}, temp, weather_main, row_number() OVER (PARTITION BY ward_id ORDER BY hourly.ts_utc)::INT AS nth FROM hourly WHERE hourly.ts_utc > {NOW} QUALIFY nth <= 5")
def flt_future(spark, sf_dir):
    return future(hourly(spark, sf_dir, NEXT_HOUR), "ward_id", 5).select("ward_id", shown("ts_utc").alias("ts_utc"), "temp", "weather_main", F.col("nth").cast("int").alias("nth"))


@query(HOURLY_SQL + f"SELECT ward_id, {TS}, temp, row_number() OVER (PARTITION BY ward_id ORDER BY hourly.ts_utc)::INT AS nth FROM hourly WHERE hourly.ts_utc > {NOW} QUALIFY nth <= 48")
def flt_clamp(spark, sf_dir):
    """Asked for 1000 hours, gives the cap."""
    return future(hourly(spark, sf_dir, NEXT_HOUR), "ward_id", 1000).select("ward_id", shown("ts_utc").alias("ts_utc"), "temp", F.col("nth").cast("int").alias("nth"))


@query("SELECT c_custkey AS ward_id, c_name AS ward_name FROM customer WHERE c_name = '000000042' OR c_name LIKE '%#000000042'")
def flt_suffix_like(spark, sf_dir):
    name = F.col("ward_name")
    return wards(spark, sf_dir).where((name == "000000042") | name.endswith("#000000042")).select("ward_id", "ward_name")


@query(HOURLY_SQL + f"SELECT ward_id, {TS}, temp, weather_main, data_kind FROM hourly QUALIFY row_number() OVER (PARTITION BY ward_id ORDER BY hourly.ts_utc DESC) = 1")
def win_distinct_on_latest(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("ward_id", "ts_utc", "temp", "weather_main", "data_kind")
    return latest_of(rows, ["ward_id"], ["ts_utc"]).withColumn("ts_utc", shown("ts_utc"))


@query(HOURLY_SQL + f"""SELECT ward_id, {TS}, temp, data_kind, hourly.ts_utc > {NOW} - INTERVAL 2 HOUR AS fresh FROM hourly WHERE hourly.ts_utc <= {NOW} + INTERVAL 30 MINUTE
QUALIFY row_number() OVER (PARTITION BY ward_id ORDER BY (hourly.ts_utc > {NOW} - INTERVAL 2 HOUR) DESC, hourly.ts_utc DESC) = 1""")
def top_latest_1(spark, sf_dir):
    rows = hourly(spark, sf_dir, until=NEXT_HOUR).withColumn("fresh", F.expr(f"ts_utc > {NOW} - INTERVAL 2 HOURS"))
    return latest_of(rows.select("ward_id", "fresh", "ts_utc", "temp", "data_kind"), ["ward_id"], ["fresh", "ts_utc"]).withColumn("ts_utc", shown("ts_utc"))


@query(HOURLY_SQL + """SELECT ward_id, (hourly.ts_utc + INTERVAL 7 HOUR)::DATE::VARCHAR AS date, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, temp FROM hourly
QUALIFY row_number() OVER (PARTITION BY ward_id, (hourly.ts_utc + INTERVAL 7 HOUR)::DATE ORDER BY abs(hour(hourly.ts_utc + INTERVAL 7 HOUR) - 12), hourly.ts_utc) = 1""")
def top_noon_nearest(spark, sf_dir):
    rows = hourly(spark, sf_dir).select("ward_id", F.to_date(civil("ts_utc")).cast("string").alias("date"), "ts_utc", "temp", F.abs(F.hour(civil("ts_utc")) - 12).alias("far"))
    best = rows.groupBy("ward_id", "date").agg(F.min(F.struct("far", "ts_utc", "temp")).alias("best"))
    return best.select("ward_id", "date", shown("best.ts_utc").alias("ts_utc"), F.col("best.temp").alias("temp"))


#: Ranking metrics: name and column of the group roll-up.
METRICS = {"nhiet_do": "avg_temp", "do_am": "avg_humidity", "gio": "avg_wind_speed", "mua": "avg_rain_1h", "uvi": "max_uvi", "ap_suat": "avg_pressure", "diem_suong": "avg_dew_point", "may": "avg_clouds"}
#: Ranking metrics of leaves.
WARD_METRICS = {"nhiet_do": "temp", "do_am": "humidity", "gio": "wind_speed", "uvi": "uvi"}
_ROLLUP_CTE = _hourly_sql("district_id").replace("\nSELECT district_id, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc", "\n, r AS (SELECT district_id, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc", 1) + ")"
_LATEST_CTE = _ROLLUP_CTE + ", latest AS (SELECT r.*, n_name AS district_name FROM r JOIN nation ON n_nationkey = district_id WHERE ts_utc = (SELECT max(ts_utc) FROM r WHERE ts_utc > '2024-01-20 04:00:00' AND ts_utc <= '2024-01-20 06:00:00'))\n"


def latest_groups(spark, sf_dir) -> DataFrame:
    """The roll-up of one instant, the latest of the two hours up to the reference instant, with the groups' names."""
    rows = group_hours(spark, sf_dir, "district_id", TWO_HOURS_AGO, NEXT_HOUR).where(F.col("ts_utc") > TWO_HOURS_AGO)
    instant = F.max("ts_utc").over(Window.partitionBy(F.lit(0)))  # a few dozen groups, two instants each
    return rows.withColumn("__at", instant).where("ts_utc = __at").drop("__at").join(F.broadcast(districts(spark, sf_dir).drop("city_id")), "district_id")


def ranking(rows: DataFrame, metric: str, descending: bool, limit: int) -> DataFrame:
    """The first `limit` (1 to 30) groups by a metric."""
    if metric not in METRICS:
        raise ValueError(f"{metric} is none of {', '.join(METRICS)}")
    value = F.col(METRICS[metric])
    order = [value.desc() if descending else value.asc(), F.col("district_name")]
    top = rows.where(value.isNotNull()).orderBy(*order).limit(max(1, min(limit, 30)))
    return top.select("district_name", value.cast("double").alias("value"), "ward_count", F.row_number().over(Window.partitionBy(F.lit(metric)).orderBy(*order)).alias("rank"))


@query(_LATEST_CTE + ", long AS (SELECT district_name, ward_count, unnest(['nhiet_do', 'do_am', 'gio', 'mua', 'uvi', 'ap_suat', 'diem_suong', 'may']) AS metric, unnest([avg_temp, avg_humidity, avg_wind_speed, avg_rain_1h, max_uvi, avg_pressure, avg_dew_point, avg_clouds]::DOUBLE[]) AS value FROM latest)\n" + """
SELECT metric, 'cao_nhat' AS "order", district_name, value, ward_count, row_number() OVER (PARTITION BY metric ORDER BY value DESC, district_name)::INT AS rank FROM long QUALIFY rank <= 5
UNION ALL SELECT metric, 'thap_nhat', district_name, value, ward_count, row_number() OVER (PARTITION BY metric ORDER BY value, district_name)::INT AS rank FROM long QUALIFY rank <= 5""")
def top_district_ranking(spark, sf_dir):
    """The five first groups of each metric, from the top and from the bottom."""
    wide = latest_groups(spark, sf_dir).select("district_name", "ward_count", *[F.col(c).cast("double").alias(m) for m, c in METRICS.items()])
    return _both_sides(wide.unpivot(["district_name", "ward_count"], list(METRICS), "metric", "value"), ["metric"], "district_name", 5)


def _both_sides(values: DataFrame, keys: list[str], name: str, limit: int) -> DataFrame:
    """The first `limit` rows of each key by value in both orders; `rank` counts within the order."""
    place = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order, name))
    ranked = values.where("value IS NOT NULL").withColumns({"__best": place(F.desc("value")), "__worst": place(F.asc("value"))})
    side = lambda order, rank: F.when(F.col(rank) <= limit, F.struct(F.lit(order).alias("order"), F.col(rank).alias("rank")))
    sides = F.explode(F.array_compact(F.array(side("cao_nhat", "__best"), side("thap_nhat", "__worst")))).alias("side")
    return ranked.select("*", sides).select(*[c for c in values.columns], "side.order", "side.rank")


@query(_LATEST_CTE + "SELECT district_id, district_name, ts_utc, avg_temp, avg_humidity, weather_main FROM latest")
def top_all_districts(spark, sf_dir):
    return latest_groups(spark, sf_dir).select("district_id", "district_name", "ts_utc", "avg_temp", "avg_humidity", "weather_main").orderBy(F.desc_nulls_last("avg_temp"), "district_name")


_SIDES = " UNION ALL ".join(f"SELECT district_name, '{m}' AS metric, {c}::DOUBLE AS value FROM latest QUALIFY row_number() OVER (ORDER BY {c} {d}, district_name) <= 5" for m, c in (("nhiet_do", "avg_temp"), ("do_am", "avg_humidity"), ("uvi", "max_uvi")) for d in ("DESC", "ASC"))


@query(_LATEST_CTE + f"SELECT district_name, max(value) FILTER (WHERE metric = 'nhiet_do') AS nhiet_do, max(value) FILTER (WHERE metric = 'do_am') AS do_am, max(value) FILTER (WHERE metric = 'uvi') AS uvi FROM ({_SIDES}) GROUP BY district_name")
def top_multi_compare(spark, sf_dir):
    return multi_compare(spark, sf_dir)


def multi_compare(spark, sf_dir, metrics: str = "nhiet_do,do_am,uvi", limit: int = 5) -> DataFrame:
    """The best and the worst `limit` groups of each metric, a row for each group; unknown metrics are left out."""
    names = [m for m in dict.fromkeys(x.strip() for x in metrics.split(",")) if m in METRICS]
    if not names:
        raise ValueError(f"no metric of {', '.join(METRICS)} in {metrics!r}")
    wide = latest_groups(spark, sf_dir).select("district_name", *[F.col(METRICS[m]).cast("double").alias(m) for m in names])
    sides = _both_sides(wide.unpivot("district_name", names, "metric", "value"), ["metric"], "district_name", max(1, min(limit, 30)))
    return sides.groupBy("district_name").pivot("metric", names).agg(F.max("value"))


_WARD_CTE = HOURLY_SQL + """, recent AS (SELECT ward_id, district_id, ts_utc, unnest(['nhiet_do', 'do_am', 'gio', 'uvi']) AS metric, unnest([temp, humidity, wind_speed, uvi]::DOUBLE[]) AS value
  FROM placed WHERE data_kind = 'current' AND ts_utc > TIMESTAMP '2024-01-20 04:00:00')
"""


@query(_WARD_CTE + """SELECT ward_id, district_id, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, metric, value, 'cao_nhat' AS "order", row_number() OVER (PARTITION BY district_id, metric ORDER BY value DESC, ward_id, recent.ts_utc)::INT AS rank FROM recent QUALIFY rank <= 10
UNION ALL SELECT ward_id, district_id, strftime(ts_utc, '%Y-%m-%d %H:%M:%S'), metric, value, 'thap_nhat', row_number() OVER (PARTITION BY district_id, metric ORDER BY value, ward_id, recent.ts_utc)::INT AS rank FROM recent QUALIFY rank <= 10""")
def top_ward_ranking(spark, sf_dir):
    return ward_ranking(spark, sf_dir, 10)


def ward_ranking(spark, sf_dir, limit: int) -> DataFrame:
    """The `limit` first leaves of each group by each metric, in both orders, among the readings of the last two hours."""
    rows = placed(spark, sf_dir, TWO_HOURS_AGO, NEXT_HOUR).where(f"data_kind = 'current' AND ts_utc > TIMESTAMP '{TWO_HOURS_AGO}'")
    wide = rows.select("ward_id", "district_id", shown("ts_utc").alias("ts_utc"), *[F.col(c).cast("double").alias(m) for m, c in WARD_METRICS.items()])
    values = wide.unpivot(["ward_id", "district_id", "ts_utc"], list(WARD_METRICS), "metric", "value").withColumn("__name", F.struct("ward_id", "ts_utc"))
    return _both_sides(values, ["district_id", "metric"], "__name", limit).drop("__name")


@query(HOURLY_SQL + "SELECT city_id, date_trunc('day', ts_utc)::DATE::VARCHAR AS date, arg_max(data_kind, (CASE data_kind WHEN 'history' THEN 2 WHEN 'current' THEN 1 ELSE 0 END, ts_utc, ward_id)) AS data_kind, arg_max(temp, (CASE data_kind WHEN 'history' THEN 2 WHEN 'current' THEN 1 ELSE 0 END, ts_utc, ward_id)) AS temp FROM placed GROUP BY ALL")
def win_distinct_on_priority(spark, sf_dir):
    order = F.struct(F.when(F.col("data_kind") == "history", 2).when(F.col("data_kind") == "current", 1).otherwise(0).alias("k"), "ts_utc", "ward_id")
    return placed(spark, sf_dir).groupBy("city_id", F.to_date("ts_utc").cast("string").alias("date")).agg(F.max_by("data_kind", order).alias("data_kind"), F.max_by("temp", order).alias("temp"))


@query("SELECT c_nationkey AS district_id, min(c_custkey) AS ward_id FROM customer GROUP BY 1")
def win_rep_ward(spark, sf_dir):
    return wards(spark, sf_dir).groupBy("district_id").agg(F.min("ward_id").alias("ward_id"))


@query(HOURLY_SQL + f"SELECT ward_id, {TS}, temp FROM hourly WHERE ward_id IN (SELECT min(c_custkey) FROM customer GROUP BY c_nationkey)")
def join_semi_rep(spark, sf_dir):
    return hourly(spark, sf_dir).join(win_rep_ward(spark, sf_dir), "ward_id", "left_semi").select("ward_id", shown("ts_utc").alias("ts_utc"), "temp")


@query(HOURLY_SQL + f"SELECT ward_id, c_name AS ward_name, {TS}, temp FROM hourly JOIN customer ON c_custkey = ward_id WHERE data_kind = 'current'")
def join_inner_ward(spark, sf_dir):
    return hourly(spark, sf_dir, "2024-01-19 06:00:00", NEXT_HOUR).where("data_kind = 'current'").join(wards(spark, sf_dir), "ward_id").select("ward_id", "ward_name", shown("ts_utc").alias("ts_utc"), "temp")


@query(HOURLY_SQL + "SELECT city_id, district_id, count(*) AS n_rows, count(DISTINCT ward_id) AS n_wards FROM placed GROUP BY ALL")
def join_inner_3way(spark, sf_dir):
    return placed(spark, sf_dir).groupBy("city_id", "district_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ward_id").alias("n_wards"))


@query(HOURLY_SQL + "SELECT r_name AS city_name, n_name AS district_name, round(avg(temp) + 1e-9, 2) AS avg_temp FROM placed p JOIN nation ON n_nationkey = district_id JOIN region ON r_regionkey = city_id GROUP BY ALL")
def join_name_lookup(spark, sf_dir):
    means = placed(spark, sf_dir).groupBy("city_id", "district_id").agg(rounded(F.avg("temp"), 2).alias("avg_temp"))
    return means.join(F.broadcast(districts(spark, sf_dir).drop("city_id")), "district_id").join(F.broadcast(cities(spark, sf_dir)), "city_id").select("city_name", "district_name", "avg_temp")


@query(HOURLY_SQL + f"SELECT ward_id, {TS}, temp FROM hourly WHERE hourly.ts_utc = (SELECT max(ts_utc) FROM hourly)")
def join_scalar_max(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return rows.join(F.broadcast(rows.agg(F.max("ts_utc").alias("ts_utc"))), "ts_utc").select("ward_id", shown("ts_utc").alias("ts_utc"), "temp")  # one row


@query(HOURLY_SQL + f"""SELECT a.ward_id, strftime(a.ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, a.temp, coalesce(nullif(a.pop, 0), b.pop) AS pop, strftime(b.ts_utc, '%Y-%m-%d %H:%M:%S') AS next_ts
FROM (SELECT * FROM hourly WHERE ts_utc <= {NOW} QUALIFY row_number() OVER (PARTITION BY ward_id ORDER BY ts_utc DESC) = 1) a
LEFT JOIN (SELECT * FROM hourly WHERE ts_utc > {NOW} QUALIFY row_number() OVER (PARTITION BY ward_id ORDER BY ts_utc) = 1) b USING (ward_id)""")
def join_row_to_latest(spark, sf_dir):
    """Forward as-of join in one aggregate: the latest row up to the instant and the first after it, by leaf."""
    past, row = F.col("ts_utc") <= as_of(), F.struct("ts_utc", "temp", "pop")
    both = hourly(spark, sf_dir).groupBy("ward_id").agg(F.max(F.when(past, row)).alias("a"), F.min(F.when(~past, row)).alias("b")).where("a IS NOT NULL")
    return both.select("ward_id", shown("a.ts_utc").alias("ts_utc"), F.col("a.temp").alias("temp"), F.coalesce(F.nullif("a.pop", F.lit(0.0)), "b.pop").alias("pop"), shown("b.ts_utc").alias("next_ts"))


@query("SELECT c_custkey AS ward_id, c_name AS ward_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def join_anti_resume(spark, sf_dir):
    done = table(spark, sf_dir, "events").select(F.col("user_id").alias("ward_id"))
    return wards(spark, sf_dir).join(done, "ward_id", "left_anti").select("ward_id", "ward_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def join_fk_orphans(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(wards(spark, sf_dir), F.col("o_custkey") == F.col("ward_id"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey AS ward_id, coalesce(n_name, c_name) AS district_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def join_update_from(spark, sf_dir):
    """Update from a look-up: the found name, else the old one."""
    found = F.broadcast(districts(spark, sf_dir).where("city_id < 3").drop("city_id"))
    return wards(spark, sf_dir).join(found, "district_id", "left").select("ward_id", F.coalesce("district_name", "ward_name").alias("district_name"))


_TWO = _daily_sql("city_id").replace("\nSELECT city_id, date::VARCHAR", "\n, days AS (SELECT city_id, date::VARCHAR", 1) + ")\n"


@query(_TWO + "SELECT date, round(a.avg_temp - b.avg_temp + 1e-9, 2) AS temp_delta, round(a.avg_humidity - b.avg_humidity + 1e-9, 1) AS humidity_delta, round(a.total_rain - b.total_rain + 1e-9, 2) AS rain_delta FROM days a JOIN days b USING (date) WHERE a.city_id = 0 AND b.city_id = 1")
def join_common_dates(spark, sf_dir):
    """Two regions' days side by side: both come from one aggregate of the days, so the roll-up is made once."""
    days = agg_city_daily(spark, sf_dir).where("city_id IN (0, 1)")
    side = lambda c, city: F.max(F.when(F.col("city_id") == city, F.col(c)))
    both = days.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *[rounded(side(c, 0) - side(c, 1), n).alias(name) for c, n, name in (("avg_temp", 2, "temp_delta"), ("avg_humidity", 1, "humidity_delta"), ("total_rain", 2, "rain_delta"))])
    return both.where("n = 2").drop("n")


REGISTRY["fn_daily_delta"] = (lambda spark, sf_dir: join_common_dates(spark, sf_dir).agg(F.min_by("date", F.struct((-F.abs("temp_delta")).alias("k"), "date")).alias("date"), F.max(F.abs("temp_delta")).alias("largest")), _TWO + "SELECT arg_min(date, (-abs(d), date)) AS date, max(abs(d)) AS largest FROM (SELECT date, round(a.avg_temp - b.avg_temp + 1e-9, 2) AS d FROM days a JOIN days b USING (date) WHERE a.city_id = 0 AND b.city_id = 1)")


@query(_TWO + "SELECT date FROM days WHERE city_id = 0 INTERSECT SELECT date FROM days WHERE city_id = 1")
def set_intersect_dates(spark, sf_dir):
    days = agg_city_daily(spark, sf_dir).where("city_id IN (0, 1)")
    return days.groupBy("date").agg(F.count_distinct("city_id").alias("n")).where("n = 2").select("date")


@query("SELECT c_custkey AS ward_id FROM customer EXCEPT ALL SELECT DISTINCT user_id FROM events")
def set_except_resume(spark, sf_dir):
    return wards(spark, sf_dir).select("ward_id").exceptAll(table(spark, sf_dir, "events").select(F.col("user_id").alias("ward_id")).distinct())


@query("SELECT * FROM (SELECT p_partkey, p_retailprice, 'top' AS side FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5) UNION ALL SELECT * FROM (SELECT p_partkey, p_retailprice, 'bottom' AS side FROM part ORDER BY p_retailprice, p_partkey LIMIT 5)")
def set_rank_union(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return rows.orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).withColumn("side", F.lit("top")).union(rows.orderBy("p_retailprice", "p_partkey").limit(5).withColumn("side", F.lit("bottom")))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def agg_distinct_dims(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


_RANK = "CASE data_kind WHEN 'history' THEN 3 WHEN 'current' THEN 2 WHEN 'forecast' THEN 1 ELSE 4 END"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], ranks: dict[str, int], arrival: list[str]) -> DataFrame:
    """Priority upsert: a row is replaced unless it outranks the new one; of equal rank the later counts.

    A row without a kind is never replaced. Both sides are narrow unions under one partial aggregate.
    """
    rank = F.lit(max(ranks.values()) + 1)
    for kind, n in ranks.items():
        rank = F.when(F.col("data_kind") == kind, n).otherwise(rank)
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))).withColumn("__rank", rank)
    return latest_of(both, keys, ["__rank", "__new", *arrival]).drop("__rank", "__new")


@query(HOURLY_SQL + f"SELECT ward_id, {TS}, temp, data_kind FROM observations QUALIFY row_number() OVER (PARTITION BY ward_id, observations.ts_utc ORDER BY {_RANK} DESC, event_id % 2 DESC, arrived DESC, event_id DESC) = 1")
def ups_priority_hourly(spark, sf_dir):
    rows = observations(spark, sf_dir).select("ward_id", "ts_utc", "arrived", "event_id", "temp", "data_kind")
    merged = upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["ward_id", "ts_utc"], {"history": 3, "current": 2, "forecast": 1}, ["arrived", "event_id"])
    return merged.select("ward_id", shown("ts_utc").alias("ts_utc"), "temp", "data_kind")


@query(HOURLY_SQL + f"SELECT ward_id, observations.ts_utc::DATE::VARCHAR AS date, temp, data_kind FROM observations WHERE data_kind <> 'current' QUALIFY row_number() OVER (PARTITION BY ward_id, observations.ts_utc::DATE ORDER BY {_RANK} DESC, event_id % 2 DESC, arrived DESC, event_id DESC) = 1")
def ups_priority_daily(spark, sf_dir):
    rows = observations(spark, sf_dir).where("data_kind <> 'current'").select("ward_id", F.to_date("ts_utc").alias("date"), "arrived", "event_id", "temp", "data_kind")
    merged = upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["ward_id", "date"], {"history": 3, "forecast": 1}, ["arrived", "event_id"])
    return merged.select("ward_id", F.col("date").cast("string").alias("date"), "temp", "data_kind")


@query(HOURLY_SQL + "SELECT district_id, arg_max(temp, (CASE data_kind WHEN 'history' THEN 3 WHEN 'forecast' THEN 2 ELSE 1 END, ts_utc, ward_id)) AS temp, arg_max(data_kind, (CASE data_kind WHEN 'history' THEN 3 WHEN 'forecast' THEN 2 ELSE 1 END, ts_utc, ward_id)) AS data_kind FROM placed GROUP BY district_id")
def ups_replace_agg(spark, sf_dir):
    """Unconditional replacement: kinds are written in the order current, forecast, history, and the last writer stays."""
    turn = F.when(F.col("data_kind") == "history", 3).when(F.col("data_kind") == "forecast", 2).otherwise(1)
    rows = placed(spark, sf_dir).select("district_id", turn.alias("turn"), "ts_utc", "ward_id", "temp", "data_kind")
    return latest_of(rows, ["district_id"], ["turn", "ts_utc", "ward_id"]).select("district_id", "temp", "data_kind")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name FROM (SELECT n_nationkey AS k, n_name AS name FROM nation) a FULL JOIN (SELECT n_nationkey + 10 AS k, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS name FROM nation) b ON a.k = b.k")
def ups_coalesce(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("old"))
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10).alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("new"))
    return old.join(new, "k", "full").select("k", F.coalesce("new", "old").alias("name"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 10, lower(n_name) FROM nation WHERE n_nationkey + 10 NOT IN (SELECT n_nationkey FROM nation)")
def ups_do_nothing(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10).alias("k"), F.lower("n_name").alias("name"))
    return old.union(new.join(old, "k", "left_anti").select("k", "name"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def win_last_k_turns(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", nth.alias("n")).where("n <= 3").drop("n")


# ---------------------------------------------------------------- names


@query(f"SELECT p_partkey, {text.normalized_sql('p_name')} AS norm FROM part")
def str_normalize_vi(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized(F.col("p_name")).alias("norm"))


PROBES = ("NATION_1", "nation 12", "nasion 7", "NATIO 20", "Region")
_PROBE_SQL = "(VALUES " + ", ".join(f"('{p}')" for p in PROBES) + ") AS t(probe)"
_SCORED = f"SELECT probe, n_name, {text.similarity_sql(text.trigrams_sql('probe'), text.trigrams_sql('n_name'))} AS score FROM nation, {_PROBE_SQL}"


def scored_names(spark, sf_dir) -> DataFrame:
    """Similarity of a stated handful of probes to every name; the probes are literals, an array on each row."""
    probes = F.explode(F.array(*map(F.lit, PROBES))).alias("probe")
    rows = table(spark, sf_dir, "nation").select("n_name", probes)
    return rows.select("probe", "n_name", text.similarity(text.trigrams(F.col("probe")), text.trigrams(F.col("n_name"))).alias("score"))


@query(_SCORED)
def str_trgm_similarity(spark, sf_dir):
    return scored_names(spark, sf_dir)


@query(f"SELECT * FROM ({_SCORED}) WHERE score >= 0.3")
def flt_trgm(spark, sf_dir):
    return scored_names(spark, sf_dir).where("score >= 0.3")


@query(f"SELECT * FROM ({_SCORED}) WHERE score >= 0.5")
def str_trgm_threshold(spark, sf_dir):
    return scored_names(spark, sf_dir).where("score >= 0.5")


@query(f"SELECT probe, n_name, score FROM ({_SCORED}) QUALIFY row_number() OVER (PARTITION BY probe ORDER BY score DESC, n_name) <= 3")
def top_fuzzy(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "n_name"))
    return scored_names(spark, sf_dir).withColumn("nth", nth).where("nth <= 3").drop("nth")


@query("SELECT conv_id, turn, sha256(concat_ws('|', conv_id::VARCHAR, turn::VARCHAR, left(sha256(text), 16), role, 'v1'))[1:32] AS key FROM conversations")
def str_hash_key(spark, sf_dir):
    key = F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.substring(F.sha2("text", 256), 1, 16), "role", F.lit("v1")), 256)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(key, 1, 32).alias("key"))


@query("SELECT conv_id, turn, left(text, 500) AS text FROM conversations")
def str_truncate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("text", 1, 500).alias("text"))


