"""Ordered-sequence operators: runs (gaps and islands), trends, drops and change detection over a series.

A series is the hourly roll-up of a region. Runs follow the adjacency of rows, not of hours; rows without a reading
are left out before neighbours are looked at. All windows are partitioned by region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.operators.rollup import _daily_sql, _hourly_sql, agg_city_daily, agg_city_hourly, group_hours
from stratiform.registry import query
from stratiform.sources.roles import AS_OF, NEXT_HOUR, WET, rounded

#: The key of a region's series.
REGION = ["city_id"]


SERIES_SQL = _hourly_sql("city_id").replace("\nSELECT city_id, strftime", "\n, series AS (SELECT city_id, strftime", 1) + ")\n"
DAYS_SQL = _daily_sql("city_id").replace("\nSELECT city_id, date::VARCHAR", "\n, days AS (SELECT city_id, date::VARCHAR", 1) + ")\n"
_WET = "('Rain', 'Drizzle', 'Thunderstorm')"


def _order(keys: list[str] = REGION):
    return Window.partitionBy(*keys).orderBy("ts_utc")


def forecast_series(spark, sf_dir, hours: int = 48) -> DataFrame:
    """The first `hours` rows of each region after the reference instant."""
    nth = F.row_number().over(_order())
    return group_hours(spark, sf_dir, "city_id", NEXT_HOUR).withColumn("nth", nth).where(F.col("nth") <= hours).drop("nth")


FORECAST_SQL = SERIES_SQL + f", f AS (SELECT * FROM series WHERE ts_utc > '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY ts_utc) <= 48)\n"


def runs(rows: DataFrame, holds: Column, key: str | list[str] = "city_id", order: str = "ts_utc") -> DataFrame:
    """`rows` for which `holds`, with `run`: the number of their stretch of neighbouring rows for which it does."""
    window = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("__holds", F.coalesce(holds, F.lit(False)))
    begins = F.col("__holds") & ~F.coalesce(F.lag("__holds").over(window), F.lit(False))
    return marked.withColumn("__begins", begins.cast("int")).withColumn("run", F.sum("__begins").over(window)).where("__holds").drop("__holds", "__begins")


def runs_sql(source: str, holds: str, columns: str) -> str:
    return f""", marked AS (SELECT *, coalesce({holds}, false) AS holds FROM {source}),
flagged AS (SELECT *, (holds AND NOT coalesce(lag(holds) OVER w, false))::INT AS begins FROM marked WINDOW w AS (PARTITION BY city_id ORDER BY ts_utc)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY city_id ORDER BY ts_utc)::BIGINT AS run FROM flagged)
SELECT city_id, run, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts, count(*) AS n_rows{columns} FROM numbered WHERE holds GROUP BY city_id, run"""


def summary(found: DataFrame, *extra: Column, keys: list[str] = REGION) -> DataFrame:
    return found.groupBy(*keys, "run").agg(F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"), F.count(F.lit(1)).alias("n_rows"), *extra)


_RAINS = f"coalesce(avg_pop, 0) >= 0.3 OR weather_main IN {_WET} OR coalesce(avg_rain_1h, 0) > 0"


def _rains() -> Column:
    return (F.coalesce("avg_pop", F.lit(0.0)) >= 0.3) | F.col("weather_main").isin(*WET) | (F.coalesce("avg_rain_1h", F.lit(0.0)) > 0)


@query(FORECAST_SQL + runs_sql("f", _RAINS, ", round(max(avg_pop) * 100 + 1e-9, 0) AS max_pop, round(max(avg_rain_1h) + 1e-9, 1) AS max_rain"))
def win_rain_periods(spark, sf_dir):
    return rain_periods(forecast_series(spark, sf_dir))


def rain_periods(rows: DataFrame, keys: list[str] = REGION) -> DataFrame:
    return summary(runs(rows, _rains(), keys), rounded(F.max("avg_pop") * 100, 0).alias("max_pop"), rounded(F.max("avg_rain_1h"), 1).alias("max_rain"), keys=keys)


@query(SERIES_SQL + runs_sql("series", _RAINS, ", round(max(avg_pop) * 100 + 1e-9, 0) AS max_pop, round(max(avg_rain_1h) + 1e-9, 1) AS max_rain"))
def win_rain_timeline(spark, sf_dir):
    """The runs of the whole series."""
    return rain_periods(agg_city_hourly(spark, sf_dir))


@query(FORECAST_SQL + f""", wet AS (SELECT *, {_RAINS} AS rains FROM f), firsts AS (SELECT city_id, min(ts_utc) FILTER (WHERE rains) AS next_rain FROM wet GROUP BY city_id),
over AS (SELECT w.city_id, min(w.ts_utc) AS first_dry FROM wet w JOIN firsts n USING (city_id) WHERE w.ts_utc > n.next_rain AND NOT rains GROUP BY ALL)
SELECT n.city_id, next_rain, (SELECT min(ts_utc) FROM wet w WHERE w.city_id = n.city_id AND w.ts_utc >= o.first_dry AND w.avg_pop < 0.3 AND w.weather_main NOT IN {_WET}) AS next_clear FROM firsts n LEFT JOIN over o USING (city_id)""")
def win_next_rain_clear(spark, sf_dir):
    """Start of the first run, and the first row after that run's end without rain or a chance of it (amounts are not looked at)."""
    rows = forecast_series(spark, sf_dir).withColumn("rains", _rains())
    rows = rows.withColumn("next_rain", F.min(F.when(F.col("rains"), F.col("ts_utc"))).over(Window.partitionBy("city_id")))
    rows = rows.withColumn("first_dry", F.min(F.when(~F.col("rains") & (F.col("ts_utc") > F.col("next_rain")), F.col("ts_utc"))).over(Window.partitionBy("city_id")))
    clear = (F.col("ts_utc") >= F.col("first_dry")) & (F.col("avg_pop") < 0.3) & ~F.col("weather_main").isin(*WET)
    return rows.groupBy("city_id").agg(F.first("next_rain").alias("next_rain"), F.min(F.when(clear, F.col("ts_utc"))).alias("next_clear"))


def kinds(rows: DataFrame, holds: Column, yes: str, no: str, keys: list[str] = REGION) -> DataFrame:
    """`rows` in runs of those for which `holds` and of the others, with the run's `kind`."""
    window = _order(keys)
    marked = rows.withColumn("kind", F.when(F.coalesce(holds, F.lit(False)), yes).otherwise(no))
    begins = ~F.col("kind").eqNullSafe(F.lag("kind").over(window))
    return marked.withColumn("__begins", begins.cast("int")).withColumn("run", F.sum("__begins").over(window)).drop("__begins")


def kinds_sql(source: str, holds: str, yes: str, no: str, columns: str) -> str:
    return f""", marked AS (SELECT *, CASE WHEN coalesce({holds}, false) THEN '{yes}' ELSE '{no}' END AS kind FROM {source}),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY city_id ORDER BY ts_utc)::BIGINT AS run FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY city_id ORDER BY ts_utc))::INT AS begins FROM marked)),
found AS (SELECT city_id, run, kind, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts, count(*) AS n_rows{columns} FROM numbered GROUP BY city_id, run, kind)"""


@query(FORECAST_SQL + kinds_sql("(SELECT * FROM f WHERE max_uvi IS NOT NULL)", "max_uvi <= 5", "safe", "danger", ", min(max_uvi) AS min_uvi, max(max_uvi) AS max_uvi") + """
SELECT w.*, p.peak_uvi, p.peak_ts FROM found w JOIN (SELECT city_id, max(max_uvi) AS peak_uvi, CASE WHEN max(max_uvi) > 0 THEN arg_min(ts_utc, (-max_uvi, ts_utc)) END AS peak_ts FROM f WHERE max_uvi IS NOT NULL GROUP BY city_id) p USING (city_id)""")
def win_uv_windows(spark, sf_dir):
    return uv_windows(forecast_series(spark, sf_dir))


def uv_windows(rows: DataFrame, limit: float = 5, keys: list[str] = REGION) -> DataFrame:
    """Runs of hours with a UV index up to `limit` and above it, with the peak of the whole series and its first hour."""
    found = kinds(rows.where("max_uvi IS NOT NULL"), F.col("max_uvi") <= limit, "safe", "danger", keys)
    own = found.groupBy(*keys, "run", "kind").agg(F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"), F.count(F.lit(1)).alias("n_rows"), F.min("max_uvi").alias("min_uvi"), F.max("max_uvi").alias("max_uvi"), F.min(F.struct((-F.col("max_uvi")).alias("k"), "ts_utc")).alias("__peak"))
    peak = F.min("__peak").over(Window.partitionBy(*keys))
    return own.withColumn("__peak", peak).withColumns({"peak_uvi": -F.col("__peak.k"), "peak_ts": F.when(F.col("__peak.k") < 0, F.col("__peak.ts_utc"))}).drop("__peak")


@query(FORECAST_SQL + kinds_sql("(SELECT * FROM f WHERE avg_clouds IS NOT NULL)", f"avg_clouds < 40 AND coalesce(avg_pop, 0) < 0.3 AND coalesce(weather_main, '') NOT IN {_WET}", "sunny", "cloudy", ", round(avg(avg_clouds) + 1e-9, 0) AS mean_clouds, max(max_uvi) AS peak_uvi") + """
SELECT *, kind = 'sunny' AND row_number() OVER (PARTITION BY city_id, kind ORDER BY n_rows DESC, run) = 1 AS best FROM found""")
def win_sunny_windows(spark, sf_dir):
    return sunny_windows(forecast_series(spark, sf_dir))


def sunny_windows(rows: DataFrame, keys: list[str] = REGION) -> DataFrame:
    """Sunny and cloudy runs; the longest sunny one, the first of equal ones, is the best."""
    sunny = (F.col("avg_clouds") < 40) & (F.coalesce("avg_pop", F.lit(0.0)) < 0.3) & ~F.coalesce("weather_main", F.lit("")).isin(*WET)
    found = kinds(rows.where("avg_clouds IS NOT NULL"), sunny, "sunny", "cloudy", keys)
    own = found.groupBy(*keys, "run", "kind").agg(F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"), F.count(F.lit(1)).alias("n_rows"), rounded(F.avg("avg_clouds"), 0).alias("mean_clouds"), F.max("max_uvi").alias("peak_uvi"))
    nth = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(F.desc("n_rows"), "run"))
    return own.withColumn("best", (F.col("kind") == "sunny") & (nth == 1))


@query(SERIES_SQL + runs_sql("series", "avg_humidity >= 85", ", max(avg_humidity) AS max_humidity"))
def win_damp_windows(spark, sf_dir):
    return summary(runs(agg_city_hourly(spark, sf_dir), F.col("avg_humidity") >= 85), F.max("avg_humidity").alias("max_humidity"))


@query(SERIES_SQL + runs_sql("(SELECT *, month(ts_utc::TIMESTAMP) AS m FROM series)", "m IN (2, 3, 4) AND avg_humidity >= 85 AND avg_temp - avg_dew_point <= 2", ", max(avg_humidity) AS max_humidity, round(min(avg_temp - avg_dew_point) + 1e-9, 2) AS least_spread"))
def win_nom_am_periods(spark, sf_dir):
    return nom_am(agg_city_hourly(spark, sf_dir))


def nom_am(rows: DataFrame, keys: list[str] = REGION) -> DataFrame:
    """Damp stretches: in February to April, hours of 85 % humidity or more within two degrees of the dew point."""
    spread = F.col("avg_temp") - F.col("avg_dew_point")
    damp = F.month(F.col("ts_utc").cast("timestamp")).isin(2, 3, 4) & (F.col("avg_humidity") >= 85) & (spread <= 2)
    return summary(runs(rows, damp, keys), F.max("avg_humidity").alias("max_humidity"), rounded(F.min(spread), 2).alias("least_spread"), keys=keys)


@query(FORECAST_SQL + """, d AS (SELECT city_id, ts_utc, avg_pressure, lag(avg_pressure, 3) OVER (PARTITION BY city_id ORDER BY ts_utc) - avg_pressure AS fall FROM f WHERE avg_pressure IS NOT NULL),
covered AS (SELECT city_id, round(count(avg_pressure) * 100.0::DOUBLE / count(*) + 1e-9, 0) AS coverage FROM f GROUP BY city_id)
SELECT city_id, any_value(coverage) AS coverage, any_value(coverage) >= 70 AS enough, round(arg_max(avg_pressure, ts_utc) - arg_min(avg_pressure, ts_utc) + 1e-9, 1) AS total_change,
  CASE WHEN arg_max(avg_pressure, ts_utc) - arg_min(avg_pressure, ts_utc) > 3 THEN 'rising' WHEN arg_max(avg_pressure, ts_utc) - arg_min(avg_pressure, ts_utc) < -3 THEN 'falling' ELSE 'stable' END AS trend,
  round(greatest(coalesce(max(fall), 0), 0) + 1e-9, 1) AS max_fall, CASE WHEN max(fall) > 0 THEN arg_min(ts_utc, (-fall, ts_utc)) FILTER (WHERE fall IS NOT NULL) END AS fall_ts,
  CASE WHEN max(fall) >= 6 THEN 'storm' WHEN max(fall) >= 3 THEN 'front' END AS warning FROM d JOIN covered USING (city_id) GROUP BY city_id""")
def win_pressure_drop_3h(spark, sf_dir):
    return pressure_drop(forecast_series(spark, sf_dir))


def pressure_drop(series: DataFrame, keys: list[str] = REGION) -> DataFrame:
    """Change and steepest three-hour fall; with readings in under 70 % of the hours it is not `enough` to warn by."""
    by = Window.partitionBy(*keys)
    covered = rounded(F.count("avg_pressure").over(by) * 100.0 / F.count(F.lit(1)).over(by), 0)
    rows = series.withColumn("coverage", covered).where("avg_pressure IS NOT NULL").withColumn("fall", F.lag("avg_pressure", 3).over(_order(keys)) - F.col("avg_pressure"))
    change, fall = F.max_by("avg_pressure", "ts_utc") - F.min_by("avg_pressure", "ts_utc"), F.max("fall")
    at = F.min_by("ts_utc", F.when(F.col("fall").isNotNull(), F.struct((-F.col("fall")).alias("f"), "ts_utc")))
    return rows.groupBy(*keys).agg(
        F.first("coverage").alias("coverage"), (F.first("coverage") >= 70).alias("enough"), rounded(change, 1).alias("total_change"), F.when(change > 3, "rising").when(change < -3, "falling").otherwise("stable").alias("trend"),
        rounded(F.greatest(F.coalesce(fall, F.lit(0.0)), F.lit(0.0)), 1).alias("max_fall"), F.when(fall > 0, at).alias("fall_ts"), F.when(fall >= 6, "storm").when(fall >= 3, "front").alias("warning"),
    )


@query(DAYS_SQL + """, d AS (SELECT *, lag(avg_temp) OVER w AS before, lead(avg_temp) OVER w AS after FROM days WHERE avg_temp IS NOT NULL WINDOW w AS (PARTITION BY city_id ORDER BY date))
SELECT city_id, round((arg_max(avg_temp, date) - arg_min(avg_temp, date)) / (count(*) - 1) + 1e-9, 2) AS slope,
  CASE WHEN (arg_max(avg_temp, date) - arg_min(avg_temp, date)) / (count(*) - 1) > 0.5 THEN 'warming' WHEN (arg_max(avg_temp, date) - arg_min(avg_temp, date)) / (count(*) - 1) < -0.5 THEN 'cooling' ELSE 'stable' END AS trend,
  min(date) FILTER (WHERE (avg_temp - before) * (after - avg_temp) < 0) AS inflection, arg_min(date, (-temp_max, date)) AS hottest, arg_min(date, (temp_min, date)) AS coldest FROM d GROUP BY city_id""")
def win_temp_trend(spark, sf_dir):
    return temp_trend(agg_city_daily(spark, sf_dir))


def temp_trend(days: DataFrame, keys: list[str] = REGION) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy("date")
    rows = days.where("avg_temp IS NOT NULL").withColumns({"before": F.lag("avg_temp").over(window), "after": F.lead("avg_temp").over(window)})
    slope = (F.max_by("avg_temp", "date") - F.min_by("avg_temp", "date")) / (F.count(F.lit(1)) - 1)
    turn = (F.col("avg_temp") - F.col("before")) * (F.col("after") - F.col("avg_temp")) < 0
    return rows.groupBy(*keys).agg(
        rounded(slope, 2).alias("slope"), F.when(slope > 0.5, "warming").when(slope < -0.5, "cooling").otherwise("stable").alias("trend"), F.min(F.when(turn, F.col("date"))).alias("inflection"),
        F.min_by("date", F.struct((-F.col("temp_max")).alias("k"), "date")).alias("hottest"), F.min_by("date", F.struct("temp_min", "date")).alias("coldest"),
    )


@query(DAYS_SQL + """SELECT city_id, date, round(avg_temp - lag(avg_temp) OVER w + 1e-9, 2) AS temp_delta, round(total_rain - lag(total_rain) OVER w + 1e-9, 2) AS rain_delta,
  CASE WHEN avg_temp - lag(avg_temp) OVER w >= 2 THEN 'warmer' WHEN avg_temp - lag(avg_temp) OVER w <= -2 THEN 'colder' ELSE 'same' END AS flag,
  CASE WHEN total_rain - lag(total_rain) OVER w >= 5 THEN 'wetter' WHEN total_rain - lag(total_rain) OVER w <= -5 THEN 'drier' ELSE 'same' END AS rain_flag FROM days WINDOW w AS (PARTITION BY city_id ORDER BY date)""")
def win_day_over_day(spark, sf_dir):
    return day_over_day(agg_city_daily(spark, sf_dir))


def day_over_day(days: DataFrame, keys: list[str] = REGION) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy("date")
    temp, rain = (F.col(c) - F.lag(c).over(window) for c in ("avg_temp", "total_rain"))
    return days.select(*keys, "date", rounded(temp, 2).alias("temp_delta"), rounded(rain, 2).alias("rain_delta"), F.when(temp >= 2, "warmer").when(temp <= -2, "colder").otherwise("same").alias("flag"), F.when(rain >= 5, "wetter").when(rain <= -5, "drier").otherwise("same").alias("rain_flag"))


_CHANGES = (
    ("temperature", "abs(avg_temp - now_temp) >= 5"),
    ("rain_start", "avg_pop - now_pop >= 0.5"),
    ("weather_change", f"now_main NOT IN {_WET} AND weather_main IN {_WET}"),
    ("rain_stop", f"now_main IN {_WET} AND weather_main NOT IN {_WET} AND avg_pop < 0.3"),
    ("wind_increase", "avg_wind_speed - now_wind >= 5"),
)
_CHANGE = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for t, c in _CHANGES) + " END"
_NOW_SQL = FORECAST_SQL + f""", now AS (SELECT city_id, avg_temp AS now_temp, avg_pop AS now_pop, avg_wind_speed AS now_wind, weather_main AS now_main FROM series WHERE ts_utc <= '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY ts_utc DESC) = 1),
c AS (SELECT f.*, now.* EXCLUDE (city_id) FROM f JOIN now USING (city_id) QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY ts_utc) <= 12)
"""


def _against_now(spark, sf_dir) -> DataFrame:
    return against_now(group_hours(spark, sf_dir, "city_id", until=NEXT_HOUR), group_hours(spark, sf_dir, "city_id", since=NEXT_HOUR))


def against_now(past: DataFrame, coming: DataFrame, hours: int = 12, keys: list[str] = REGION) -> DataFrame:
    """The first `hours` rows of `coming` with the readings of the last row of `past`, which is a partial aggregate: no
    place's past is sorted or gathered."""
    readings = {"now_temp": "avg_temp", "now_pop": "avg_pop", "now_wind": "avg_wind_speed", "now_main": "weather_main"}
    last = past.groupBy(*keys).agg(F.max(F.struct("ts_utc", *[F.col(c).alias(name) for name, c in readings.items()])).alias("now"))
    rows = coming.withColumn("nth", F.row_number().over(_order(keys))).where(F.col("nth") <= hours)
    return rows.join(last.select(*keys, *[F.col(f"now.{name}").alias(name) for name in readings]), keys)


@query(_NOW_SQL + f"SELECT city_id, min(ts_utc) AS ts_utc, arg_min({_CHANGE}, ts_utc) AS change FROM c WHERE {_CHANGE} IS NOT NULL GROUP BY city_id")
def win_change_detect_first(spark, sf_dir):
    """The first hour with any change against now, and its most important one."""
    return first_change(_against_now(spark, sf_dir))


def first_change(compared: DataFrame, keys: list[str] = REGION) -> DataFrame:
    rows = compared.withColumn("change", F.expr(_CHANGE)).where("change IS NOT NULL")
    return rows.groupBy(*keys).agg(F.min("ts_utc").alias("ts_utc"), F.min_by("change", "ts_utc").alias("change"))


@query(_NOW_SQL + " UNION ALL ".join(f"SELECT city_id, '{t}' AS change, min(ts_utc) AS ts_utc FROM c WHERE {c} GROUP BY city_id" for t, c in _CHANGES))
def win_change_detect_per_type(spark, sf_dir):
    hits = F.array_compact(F.array(*[F.when(F.expr(c), t) for t, c in _CHANGES]))
    return _against_now(spark, sf_dir).select("city_id", "ts_utc", F.explode(hits).alias("change")).groupBy("city_id", "change").agg(F.min("ts_utc").alias("ts_utc"))


@query("SELECT conv_id, sum(ok)::BIGINT AS prefix FROM (SELECT conv_id, min(CASE WHEN length(text) % 5 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ok FROM conversations) GROUP BY conv_id")
def win_island_crr(spark, sf_dir):
    """Length of the correct prefix of each thread; a turn counts as correct unless its length is a multiple of five."""
    ok = F.min(F.when(F.length("text") % 5 != 0, 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", ok.alias("ok")).groupBy("conv_id").agg(F.sum("ok").alias("prefix"))


@query(SERIES_SQL + """, p AS (SELECT city_id, d, part, a, b FROM (SELECT DISTINCT city_id, ts_utc[1:10] AS d FROM series), (VALUES ('rạng sáng', 2, 6), ('sáng', 6, 11), ('trưa', 11, 13), ('chiều', 13, 18), ('tối', 18, 22)) AS t(part, a, b))
SELECT p.city_id, p.d AS date, part FROM p WHERE NOT EXISTS (SELECT 1 FROM series s WHERE s.city_id = p.city_id AND s.ts_utc[1:10] = p.d AND ts_utc[12:13]::INT >= a AND ts_utc[12:13]::INT < b)""")
def win_range_gap(spark, sf_dir):
    """Parts of each day without a row: covered parts are flags of one aggregate, so nothing is crossed."""
    parts = (("rạng sáng", 2, 6), ("sáng", 6, 11), ("trưa", 11, 13), ("chiều", 13, 18), ("tối", 18, 22))
    hour = F.substring("ts_utc", 12, 2).cast("int")
    flags = agg_city_hourly(spark, sf_dir).groupBy("city_id", F.substring("ts_utc", 1, 10).alias("date")).agg(*[F.max((hour >= a) & (hour < b)).alias(name) for name, a, b in parts])
    missing = F.array_compact(F.array(*[F.when(~F.col(name), name) for name, _, _ in parts]))
    return flags.select("city_id", "date", F.explode(missing).alias("part"))
