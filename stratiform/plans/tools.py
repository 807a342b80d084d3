"""The 28 public tools as functions of place and parameters, and registered with their defaults for every place at every level.

A tool takes `levels` and `place`, and what else it can be asked for. One answer for all places is one job; asked for
one place it is the same plan with a filter on the key, which Catalyst pushes below the aggregates and windows.
"""

from __future__ import annotations

from datetime import date as Date
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions import bands
from stratiform.operators import advice, runs, snapshot
from stratiform.plans.levels import DAYS_ALL, HOURS, LEVELS, PLACE, RAW_SQL, SERIES_ALL, days, forecast, forecast_sql, known, last_facts, raw, series
from stratiform.registry import REGISTRY, query
from stratiform.sources.roles import AS_OF, NEXT_DAY, NEXT_HOUR, TWO_HOURS_AGO, districts, hourly, rounded

TODAY = AS_OF[:10]


def _everywhere(sql: str, source: str) -> str:
    """An oracle of regions, asked for all places."""
    return sql.removeprefix(source).replace("city_id", "level, place_id")


def _by_place(*order) -> Window:
    return Window.partitionBy(*PLACE).orderBy(*order)


@query(SERIES_ALL + "SELECT level, place_id, ts_utc, round(avg_temp, 6) AS temp, weather_main FROM series")
def disp_level_dispatch(spark, sf_dir):
    """The hours of every leaf, group and region under common names, from one scan."""
    return series(spark, sf_dir).select(*PLACE, "ts_utc", F.round("avg_temp", 6).alias("temp"), "weather_main")


# ---------------------------------------------------------------- now


def latest(spark, sf_dir, levels=LEVELS, place: int | None = None) -> DataFrame:
    """The last row of each place up to the reference instant; `fresh` if it is of the last two hours."""
    rows = series(spark, sf_dir, levels, place, facts=last_facts(spark, sf_dir, levels, place))
    row = F.max(F.struct("ts_utc", F.struct(*HOURS, "weather_main").alias("r"))).alias("best")
    return rows.groupBy(*PLACE).agg(row).select(*PLACE, "best.ts_utc", "best.r.*").withColumn("fresh", F.col("ts_utc") > TWO_HOURS_AGO)


_LATEST = SERIES_ALL + f", latest AS (SELECT *, ts_utc > '{TWO_HOURS_AGO}' AS fresh FROM series WHERE ts_utc <= '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY level, place_id ORDER BY ts_utc DESC) = 1),\nraw AS (SELECT level, place_id, ts_utc, fresh, weather_main, month(ts_utc::TIMESTAMP) AS m, {RAW_SQL} FROM latest)\n"
_PHENOMENA = "list_filter([" + ", ".join(f"CASE WHEN {advice._SEVERITY[n]} IS NOT NULL THEN '{n}' END" for n in advice._NAMES) + "], lambda x: x IS NOT NULL)"


def _month() -> Column:
    return F.month(F.col("ts_utc").cast("timestamp"))


def _phenomena() -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(advice._SEVERITY[n]).isNotNull(), n) for n in advice._NAMES]))


@query(_LATEST + f"""SELECT level, place_id, ts_utc, fresh, temp, humidity, weather_main, round({advice._HEAT_SQL} + 1e-9, 1) AS heat_index, round({advice._CHILL_SQL} + 1e-9, 1) AS wind_chill,
  CASE WHEN temp - mean_temp > 3 THEN 'warmer' WHEN temp - mean_temp < -3 THEN 'colder' ELSE 'usual' END AS season, array_to_string({_PHENOMENA}, ', ') AS phenomena FROM raw JOIN {advice._CLIMATE_SQL} ON m = c.month""")
def get_current_weather(spark, sf_dir, levels=LEVELS, place=None):
    rows = raw(latest(spark, sf_dir, levels, place)).withColumn("m", _month())
    usual = F.element_at(F.array(*[F.lit(row[1]) for row in advice.CLIMATE]), F.col("m"))
    gap = F.col("temp") - usual
    return rows.select(
        *PLACE, "ts_utc", "fresh", "temp", "humidity", "weather_main", rounded(bands.heat_index(F.col("temp"), F.col("humidity")), 1).alias("heat_index"), rounded(bands.wind_chill(F.col("temp"), F.col("wind_speed")), 1).alias("wind_chill"),
        F.when(gap > 3, "warmer").when(gap < -3, "colder").otherwise("usual").alias("season"), F.array_join(_phenomena(), ", ").alias("phenomena"),
    )


@query(_LATEST + f"SELECT level, place_id, ts_utc, CASE WHEN temp - mean_temp > 3 THEN 'warmer' WHEN temp - mean_temp < -3 THEN 'colder' ELSE 'usual' END AS warmth, CASE WHEN humidity - mean_humidity > 10 THEN 'damper' WHEN humidity - mean_humidity < -10 THEN 'drier' ELSE 'usual' END AS damp, mean_temp::INT AS mean_temp, rain_days::INT AS rain_days FROM raw JOIN {advice._CLIMATE_SQL} ON m = c.month")
def get_seasonal_comparison(spark, sf_dir, levels=LEVELS, place=None):
    rows = raw(latest(spark, sf_dir, levels, place)).withColumn("m", _month())
    mean_temp, mean_humidity, rain_days = (F.element_at(F.array(*[F.lit(row[k]) for row in advice.CLIMATE]), F.col("m")) for k in (1, 2, 3))
    t, h = F.col("temp") - mean_temp, F.col("humidity") - mean_humidity
    return rows.select(*PLACE, "ts_utc", F.when(t > 3, "warmer").when(t < -3, "colder").otherwise("usual").alias("warmth"), F.when(h > 10, "damper").when(h < -10, "drier").otherwise("usual").alias("damp"), mean_temp.alias("mean_temp"), rain_days.alias("rain_days"))


@query(_LATEST + " UNION ALL ".join(f"SELECT level, place_id, ts_utc, '{n}' AS kind, {advice._SEVERITY[n]} AS severity FROM raw WHERE {advice._SEVERITY[n]} IS NOT NULL" for n in advice._NAMES))
def detect_phenomena(spark, sf_dir, levels=LEVELS, place=None):
    hits = F.array_compact(F.array(*[F.when(F.expr(advice._SEVERITY[n]).isNotNull(), F.struct(F.lit(n).alias("kind"), F.expr(advice._SEVERITY[n]).alias("severity"))) for n in advice._NAMES]))
    return raw(latest(spark, sf_dir, levels, place)).withColumn("m", _month()).select(*PLACE, "ts_utc", F.explode(hits).alias("hit")).select(*PLACE, "ts_utc", "hit.kind", "hit.severity")


@query(_LATEST + f"SELECT level, place_id, ts_utc, {advice._COMFORT_SQL} AS score, {bands.band_sql(advice._COMFORT_SQL, bands.COMFORT_LEVELS)} AS label FROM raw")
def get_comfort_index(spark, sf_dir, levels=LEVELS, place=None):
    score = bands.comfort(F.col("temp"), F.col("humidity"), F.col("wind_speed"), F.col("uvi"), F.col("pop"))
    return raw(latest(spark, sf_dir, levels, place)).select(*PLACE, "ts_utc", score.alias("score"), bands.banded(score, bands.COMFORT_LEVELS).alias("label"))


@query(_LATEST + f"SELECT level, place_id, ts_utc, {advice.clothing_sql(wind=advice.GUSTS)} AS items, {advice.clothing_sql(advice.CLOTHING_NOTES, advice.GUSTS)} AS notes FROM raw")
def get_clothing_advice(spark, sf_dir, levels=LEVELS, place=None, hours_ahead: int = 0):
    """What to wear and what to mind now, or in the hour `hours_ahead` rows from now; gusts count as wind."""
    rows = forecast(spark, sf_dir, hours_ahead, levels, place).where(F.col("nth") == hours_ahead) if hours_ahead else latest(spark, sf_dir, levels, place)
    return raw(rows).select(*PLACE, "ts_utc", advice.clothing(wind=advice.GUSTS).alias("items"), advice.clothing(advice.CLOTHING_NOTES, advice.GUSTS).alias("notes"))


@query("SELECT level, place_id, ts_utc, activity, issues, severity, verdict FROM (" + _LATEST + advice.advice_sql("raw", "level, place_id, ts_utc") + ")")
def get_activity_advice(spark, sf_dir, levels=LEVELS, place=None, activities=None):
    return advice.activity_advice(raw(latest(spark, sf_dir, levels, place)), activities).select(*PLACE, "ts_utc", "activity", "issues", "severity", "verdict")


@query(_LATEST + """SELECT a.level, a.place_id AS first, b.place_id AS second, round(a.temp - b.temp + 1e-9, 1) AS temp_diff, round(a.humidity - b.humidity + 1e-9, 1) AS humidity_diff, round(a.clouds - b.clouds + 1e-9, 1) AS clouds_diff,
  round(a.rain_1h - b.rain_1h + 1e-9, 1) AS rain_1h_diff, round(a.wind_speed - b.wind_speed + 1e-9, 1) AS wind_speed_diff, CASE WHEN abs(a.temp - b.temp) <= 2 THEN 'similar' WHEN a.temp > b.temp THEN 'first is warmer' ELSE 'second is warmer' END AS verdict
FROM raw a JOIN raw b ON a.level = b.level AND b.place_id = a.place_id + 1""")
def compare_weather(spark, sf_dir, pairs: DataFrame | None = None):
    """Two places now, by (level, first, second); each place with the next one where none are given. A place is not compared with itself."""
    now = raw(latest(spark, sf_dir)).select(*PLACE, "temp", "humidity", "clouds", "rain_1h", "wind_speed")
    return _compared(now, pairs, {"temp": 1, "humidity": 1, "clouds": 1, "rain_1h": 1, "wind_speed": 1}, [])


# What is told of two places' difference: its words, unit, digits, and the least difference that is told.
CHANGES = (("temp", "chênh nhiệt độ", "°C", 1, 0), ("humidity", "chênh độ ẩm", "%", 0, 0), ("clouds", "chênh mây", "%", 0, 10), ("rain_1h", "chênh cường độ mưa", " mm/h", 2, 0.1), ("wind_speed", "chênh gió", " m/s", 1, 1))


def _change_sql(name: str, words: str, unit: str, digits: int, least: float) -> str:
    gap = f"(round(a.{name} - b.{name} + 1e-9, 1) + 0.0)"
    return f"CASE WHEN abs({gap}) >= {least} THEN '{words} ' || printf('%+.{digits}f', round({gap}, {digits})) || '{unit}' END"


@query(_LATEST + f"""SELECT a.level, a.place_id AS first, b.place_id AS second, array_to_string(list_filter([{', '.join(_change_sql(*c) for c in CHANGES)}], lambda x: x IS NOT NULL), '; ') AS text
FROM raw a JOIN raw b ON a.level = b.level AND b.place_id = a.place_id + 1""")
def fn_change_text(spark, sf_dir):
    """The difference of two places now in words: temperature and humidity always, clouds, rain and wind from their least values on."""
    said = []
    for name, words, unit, digits, least in CHANGES:
        gap = F.col(f"{name}_diff") + 0.0
        said.append(F.when(F.abs(gap) >= least, F.concat(F.lit(f"{words} "), F.format_string(f"%+.{digits}f", F.round(gap, digits)), F.lit(unit))))
    return compare_weather(spark, sf_dir).select("level", "first", "second", F.array_join(F.array_compact(F.array(*said)), "; ").alias("text"))


def _compared(rows: DataFrame, pairs: DataFrame | None, columns: dict[str, int], also: list[str]) -> DataFrame:
    first = rows.select("level", F.col("place_id").alias("first"), *also, *[F.col(c).alias(f"__a_{c}") for c in columns])
    second = rows.select("level", F.col("place_id").alias("second"), *also, *[F.col(c).alias(f"__b_{c}") for c in columns])
    first = first.withColumn("second", F.col("first") + 1) if pairs is None else first.join(pairs.where("first <> second"), ["level", "first"])
    gap = {c: F.col(f"__a_{c}") - F.col(f"__b_{c}") for c in columns}
    main = next(iter(columns))
    verdict = F.when(F.abs(gap[main]) <= 2, "similar").when(gap[main] > 0, "first is warmer").otherwise("second is warmer")
    return first.join(second, ["level", "second", *also]).select("level", "first", "second", *also, *[rounded(gap[c], n).alias(f"{c}_diff") for c, n in columns.items()], verdict.alias("verdict"))


@query(DAYS_ALL + f"""SELECT a.level, a.place_id AS first, b.place_id AS second, a.date, round(a.avg_temp - b.avg_temp + 1e-9, 1) AS avg_temp_diff, round(a.avg_humidity - b.avg_humidity + 1e-9, 1) AS avg_humidity_diff, round(a.total_rain - b.total_rain + 1e-9, 1) AS total_rain_diff,
  CASE WHEN abs(a.avg_temp - b.avg_temp) <= 2 THEN 'similar' WHEN a.avg_temp > b.avg_temp THEN 'first is warmer' ELSE 'second is warmer' END AS verdict
FROM days a JOIN days b ON a.level = b.level AND b.place_id = a.place_id + 1 AND a.date = b.date WHERE a.date BETWEEN '{TODAY}' AND '2024-01-21'""")
def compare_weather_forecast(spark, sf_dir, pairs: DataFrame | None = None, start_date: str = TODAY, n_days: int = 2):
    """Two places on their common days from `start_date` on."""
    wanted = days(spark, sf_dir, since=_shift(start_date, -1), until=_shift(start_date, n_days)).where(F.col("date").between(start_date, _shift(start_date, n_days - 1)[:10]))
    return _compared(wanted, pairs, {"avg_temp": 1, "avg_humidity": 1, "total_rain": 1}, ["date"])


def _shift(date: str, n: int) -> str:
    """Midnight UTC, `n` days after a date. A civil day begins seven hours before its date does in UTC."""
    return f"{Date.fromisoformat(date) + timedelta(days=n)} 00:00:00"


# ---------------------------------------------------------------- hours to come


@query(forecast_sql(24) + f"""SELECT level, place_id, nth, ts_utc, avg_temp, avg_pop, weather_main, (""" + " + ".join(f"(avg_wind_speed >= {b})::INT" for b in (0.5, 1.5, 3.3, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 32.7)) + """) AS force,
  count(*) OVER (PARTITION BY level, place_id, ts_utc[1:10]) AS day_rows, coalesce(date_diff('hour', lag(ts_utc::TIMESTAMP) OVER (PARTITION BY level, place_id ORDER BY ts_utc), ts_utc::TIMESTAMP) - 1, 0)::BIGINT AS gap FROM f""")
def get_hourly_forecast(spark, sf_dir, levels=LEVELS, place=None, hours: int = 24):
    """The next hours with wind force, how many rows their day has, and the hours missing before each."""
    seconds = F.unix_timestamp(F.col("ts_utc").cast("timestamp"))
    gap = F.coalesce(((seconds - F.lag(seconds).over(_by_place("ts_utc"))) / 3600).cast("long") - 1, F.lit(0))
    own = F.count(F.lit(1)).over(Window.partitionBy(*PLACE, F.substring("ts_utc", 1, 10)))
    return forecast(spark, sf_dir, hours, levels, place).select(*PLACE, "nth", "ts_utc", "avg_temp", "avg_pop", "weather_main", bands.beaufort(F.col("avg_wind_speed")).alias("force"), own.alias("day_rows"), gap.alias("gap"))


@query(DAYS_ALL + f"""SELECT level, place_id, date, avg_temp, temp_min, temp_max, total_rain, weather_main, row_number() OVER (w ORDER BY temp_max DESC, date) = 1 AS hottest, row_number() OVER (w ORDER BY temp_min, date) = 1 AS coolest, row_number() OVER (w ORDER BY total_rain DESC, date) = 1 AS rainiest
FROM (SELECT * FROM days WHERE date >= '{TODAY}' QUALIFY row_number() OVER (PARTITION BY level, place_id ORDER BY date) <= 7) WINDOW w AS (PARTITION BY level, place_id)""")
def get_daily_forecast(spark, sf_dir, levels=LEVELS, place=None, n_days: int = 7, start_date: str = TODAY):
    """Up to `n_days` days from a date on, with the hottest, coolest and rainiest of them."""
    nth = F.row_number().over(_by_place("date"))
    found = days(spark, sf_dir, levels, place, since=_shift(start_date, -1)).where(F.col("date") >= start_date).withColumn("nth", nth).where(F.col("nth") <= n_days)
    first = lambda *order: F.row_number().over(_by_place(*order, "date")) == 1
    return found.select(*PLACE, "date", "avg_temp", "temp_min", "temp_max", "total_rain", "weather_main", first(F.desc("temp_max")).alias("hottest"), first("temp_min").alias("coolest"), first(F.desc("total_rain")).alias("rainiest"))


@query(forecast_sql(24) + _everywhere(REGISTRY["win_rain_periods"][1], runs.FORECAST_SQL))
def get_rain_timeline(spark, sf_dir, levels=LEVELS, place=None, hours: int = 24):
    return runs.rain_periods(forecast(spark, sf_dir, hours, levels, place), PLACE)


@query(forecast_sql(24) + f""", raw AS (SELECT level, place_id, ts_utc, weather_main, {RAW_SQL} FROM f), scored AS (SELECT activity, level, place_id, ts_utc, {advice._SCORE}::DOUBLE AS score FROM raw, {advice._ACTIVITY_SQL} WHERE temp IS NOT NULL)
SELECT level, place_id, activity, side, ts_utc, score FROM (SELECT *, row_number() OVER (PARTITION BY activity, level, place_id ORDER BY score DESC, ts_utc) AS nth, count(*) OVER (PARTITION BY activity, level, place_id) AS n FROM scored), (VALUES ('best'), ('worst')) AS v(side)
WHERE (side = 'best' AND nth <= 5) OR (side = 'worst' AND n > 3 AND nth > n - 3)""")
def get_best_time(spark, sf_dir, levels=LEVELS, place=None, hours: int = 24, activities=None):
    """The best five and worst three hours of each activity; one that is not known is judged by the common rule."""
    scored = advice.scored(raw(forecast(spark, sf_dir, hours, levels, place)), PLACE, activities)
    return advice.best_and_worst(scored, PLACE)


@query(f"SELECT level, place_id, ts_utc, change FROM (" + forecast_sql(6) + _everywhere(REGISTRY["win_change_detect_first"][1], runs.FORECAST_SQL).replace("<= 12", "<= 6") + ")")
def get_weather_change_alert(spark, sf_dir, levels=LEVELS, place=None, hours: int = 6):
    return runs.first_change(runs.against_now(series(spark, sf_dir, levels, place, until=NEXT_HOUR), series(spark, sf_dir, levels, place, since=NEXT_HOUR), hours, PLACE), PLACE)


@query(forecast_sql(24) + _everywhere(REGISTRY["win_uv_windows"][1], runs.FORECAST_SQL))
def get_uv_safe_windows(spark, sf_dir, levels=LEVELS, place=None, hours: int = 24, max_uvi: float = 5):
    return runs.uv_windows(forecast(spark, sf_dir, hours, levels, place), max_uvi, PLACE)


@query(forecast_sql(24) + _everywhere(REGISTRY["win_pressure_drop_3h"][1], runs.FORECAST_SQL))
def get_pressure_trend(spark, sf_dir, levels=LEVELS, place=None, hours: int = 24):
    return runs.pressure_drop(forecast(spark, sf_dir, hours, levels, place), PLACE)


@query(forecast_sql(24) + _everywhere(REGISTRY["win_sunny_windows"][1], runs.FORECAST_SQL))
def get_sunny_periods(spark, sf_dir, levels=LEVELS, place=None, hours: int = 24):
    return runs.sunny_windows(forecast(spark, sf_dir, hours, levels, place), PLACE)


_DEW = "coalesce(avg_dew_point, round(CASE WHEN avg_humidity > 0 THEN 243.04::DOUBLE * (ln(avg_humidity / 100) + 17.625::DOUBLE * avg_temp / (243.04::DOUBLE + avg_temp)) / (17.625::DOUBLE - ln(avg_humidity / 100) - 17.625::DOUBLE * avg_temp / (243.04::DOUBLE + avg_temp)) END, 1))"


@query(forecast_sql(24) + f""", d AS (SELECT *, {_DEW} AS dew FROM f)
SELECT level, place_id, ts_utc, avg_humidity, dew, CASE WHEN dew > 24 THEN 'Rất oi bức' WHEN dew > 20 THEN 'Oi bức' WHEN dew > 16 THEN 'Dễ chịu' WHEN dew > 10 THEN 'Khô ráo' WHEN dew <= 10 THEN 'Rất khô' END AS comfort,
  coalesce(month(ts_utc::TIMESTAMP) IN (2, 3, 4) AND avg_humidity >= 85 AND avg_temp - dew <= 2, false) AS damp, round(avg(avg_humidity) OVER (PARTITION BY level, place_id) + 1e-9, 0) AS mean_humidity, dew IS NOT NULL AND row_number() OVER (PARTITION BY level, place_id ORDER BY abs(dew - 18), ts_utc) = 1 AS most_comfortable FROM d""")
def get_humidity_timeline(spark, sf_dir, levels=LEVELS, place=None, hours: int = 24):
    """Humidity and dew point by the hour, how they feel, damp hours of spring, and the most comfortable hour."""
    humidity, temp = F.col("avg_humidity"), F.col("avg_temp")
    steep = F.log(humidity / 100) + 17.625 * temp / (243.04 + temp)
    magnus = F.round(F.when(humidity > 0, 243.04 * steep / (17.625 - steep)), 1)
    rows = forecast(spark, sf_dir, hours, levels, place).withColumn("dew", F.coalesce("avg_dew_point", magnus))
    dew = F.col("dew")
    feels = F.when(dew > 24, "Rất oi bức").when(dew > 20, "Oi bức").when(dew > 16, "Dễ chịu").when(dew > 10, "Khô ráo").when(dew <= 10, "Rất khô")
    damp = _month().isin(2, 3, 4) & (humidity >= 85) & (temp - dew <= 2)
    nearest = F.row_number().over(_by_place(F.asc_nulls_last(F.abs(dew - 18)), "ts_utc"))
    return rows.select(*PLACE, "ts_utc", "avg_humidity", "dew", feels.alias("comfort"), F.coalesce(damp, F.lit(False)).alias("damp"), rounded(F.avg("avg_humidity").over(Window.partitionBy(*PLACE)), 0).alias("mean_humidity"), (dew.isNotNull() & (nearest == 1)).alias("most_comfortable"))


@query(advice.HOURLY_SQL + advice._ALERTS_SQL + f""", leaves AS ({' UNION ALL '.join(f"SELECT ward_id, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, '{n}' AS alert FROM hourly WHERE data_kind = 'forecast' AND hourly.ts_utc > TIMESTAMP '{AS_OF}' AND hourly.ts_utc < TIMESTAMP '{NEXT_DAY}' AND {c}" for n, c in advice.ALERTS)})
SELECT 'district' AS level, district_id::BIGINT AS place_id, ts_utc, alert FROM found UNION ALL SELECT 'ward', ward_id, ts_utc, alert FROM leaves""")
def get_weather_alerts(spark, sf_dir, levels=("district", "ward"), place=None):
    """Alerts of the next day: of each leaf, of groups by their representative leaf, and of regions by those of their groups."""
    known(levels)
    groups = advice.alerts(advice.representative_facts(spark, sf_dir)).select(F.lit("district").alias("level"), F.col("district_id").cast("long").alias("place_id"), "ts_utc", "alert")
    leaves = advice.alerts(hourly(spark, sf_dir, NEXT_HOUR, NEXT_DAY).where("data_kind = 'forecast'").withColumn("district_id", F.lit(None))).select(F.lit("ward").alias("level"), F.col("ward_id").alias("place_id"), "ts_utc", "alert")
    regions = groups.join(F.broadcast(districts(spark, sf_dir)), F.col("place_id") == F.col("district_id")).select(F.lit("city").alias("level"), F.col("city_id").cast("long").alias("place_id"), "ts_utc", "alert").distinct()  # groups number a few dozen
    found = {"district": groups, "ward": leaves, "city": regions}
    out = found[levels[0]]
    for level in levels[1:]:
        out = out.union(found[level])
    return out if place is None else out.where(F.col("place_id") == place)


# ---------------------------------------------------------------- days


def _civil_day(date: str) -> tuple[str, str]:
    """The UTC bounds of a civil day, on the hour."""
    return _shift(date, -1)[:11] + "17:00:00", date + " 17:00:00"


_DAY = "2024-01-12"
_OF_DAY = SERIES_ALL + f", hours AS (SELECT *, hour(ts_utc::TIMESTAMP + INTERVAL 7 HOUR) AS h FROM series WHERE (ts_utc::TIMESTAMP + INTERVAL 7 HOUR)::DATE = DATE '{_DAY}')\n"


@query(_OF_DAY + "SELECT level, place_id, ts_utc, avg_temp, avg_humidity, weather_main, abs(h - 12)::INT AS far FROM hours QUALIFY row_number() OVER (PARTITION BY level, place_id ORDER BY abs(h - 12), ts_utc) = 1")
def get_weather_history(spark, sf_dir, levels=LEVELS, place=None, date: str = _DAY):
    """The reading of a past day that is nearest to noon."""
    far = F.abs(F.hour(F.col("ts_utc").cast("timestamp") + F.expr("INTERVAL 7 HOURS")) - 12)
    rows = series(spark, sf_dir, levels, place, *_civil_day(date)).withColumn("far", far)
    return rows.groupBy(*PLACE).agg(F.min(F.struct("far", "ts_utc", "avg_temp", "avg_humidity", "weather_main")).alias("b")).select(*PLACE, "b.ts_utc", "b.avg_temp", "b.avg_humidity", "b.weather_main", "b.far")


@query(_OF_DAY + """, parts AS (SELECT *, CASE WHEN h >= 6 AND h < 10 THEN 'sáng' WHEN h >= 10 AND h < 14 THEN 'trưa' WHEN h >= 14 AND h < 18 THEN 'chiều' WHEN h >= 18 AND h < 22 THEN 'tối' END AS part FROM hours)
SELECT level, place_id, part, count(*) AS n_rows, round(avg(avg_temp) + 1e-9, 1) AS mean_temp, min(avg_temp) AS least_temp, max(avg_temp) AS most_temp, max(max_uvi) AS max_uvi, max(avg_pop) AS max_pop FROM parts WHERE part IS NOT NULL GROUP BY ALL""")
def get_daily_rhythm(spark, sf_dir, levels=LEVELS, place=None, date: str = _DAY):
    """The parts of a civil day."""
    h = F.hour(F.col("ts_utc").cast("timestamp") + F.expr("INTERVAL 7 HOURS"))
    part = F.when((h >= 6) & (h < 10), "sáng").when((h >= 10) & (h < 14), "trưa").when((h >= 14) & (h < 18), "chiều").when((h >= 18) & (h < 22), "tối")
    rows = series(spark, sf_dir, levels, place, *_civil_day(date)).withColumn("part", part).where("part IS NOT NULL")
    return rows.groupBy(*PLACE, "part").agg(F.count(F.lit(1)).alias("n_rows"), rounded(F.avg("avg_temp"), 1).alias("mean_temp"), F.min("avg_temp").alias("least_temp"), F.max("avg_temp").alias("most_temp"), F.max("max_uvi").alias("max_uvi"), F.max("avg_pop").alias("max_pop"))


@query(DAYS_ALL + f"""SELECT level, place_id, date, avg_temp, round(temp_max - temp_min + 1e-9, 1) AS temp_range, temp_max - temp_min > 10 AS notable, CASE WHEN total_rain = 0 THEN 'Không mưa' WHEN total_rain < 10 THEN 'Mưa nhẹ' WHEN total_rain < 25 THEN 'Mưa vừa' ELSE 'Mưa to' END AS rain,
  {bands.band_sql('max_uvi', bands.UV_DAILY)} AS uv, {bands.band_sql('avg_dew_point', bands.DEW_GROUP, True)} AS dew FROM days WHERE date = '{_DAY}'""")
def get_daily_summary(spark, sf_dir, levels=LEVELS, place=None, date: str = _DAY):
    """A day in bands: its range, rain, UV and dew point."""
    spread, rain = F.col("temp_max") - F.col("temp_min"), F.col("total_rain")
    rows = days(spark, sf_dir, levels, place, *_civil_day(date)).where(F.col("date") == date)
    return rows.select(*PLACE, "date", "avg_temp", rounded(spread, 1).alias("temp_range"), (spread > 10).alias("notable"), F.when(rain == 0, "Không mưa").when(rain < 10, "Mưa nhẹ").when(rain < 25, "Mưa vừa").otherwise("Mưa to").alias("rain"), bands.banded(F.col("max_uvi"), bands.UV_DAILY).alias("uv"), bands.banded(F.col("avg_dew_point"), bands.DEW_GROUP, True).alias("dew"))


@query(DAYS_ALL + "SELECT level, place_id, round(avg(avg_temp) + 1e-9, 2) AS mean_temp, min(temp_min) AS min_temp, max(temp_max) AS max_temp, round(sum(total_rain) + 1e-9, 2) AS rain, count(*) FILTER (WHERE total_rain > 0.5) AS rain_days, count(*) AS n_days, count(*) FILTER (WHERE avg_temp < 15) AS cold_days, count(*) FILTER (WHERE temp_max >= 35) AS hot_days FROM days WHERE date BETWEEN '2024-01-10' AND '2024-01-16' GROUP BY level, place_id")
def get_weather_period(spark, sf_dir, levels=LEVELS, place=None, start_date: str = "2024-01-10", end_date: str = "2024-01-16"):
    """A period's means, extremes, rainy, cold and hot days."""
    rows = days(spark, sf_dir, levels, place, _civil_day(start_date)[0], _civil_day(end_date)[1]).where(F.col("date").between(start_date, end_date))
    return rows.groupBy(*PLACE).agg(
        rounded(F.avg("avg_temp"), 2).alias("mean_temp"), F.min("temp_min").alias("min_temp"), F.max("temp_max").alias("max_temp"), rounded(F.sum("total_rain"), 2).alias("rain"), F.count_if(F.col("total_rain") > 0.5).alias("rain_days"),
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("avg_temp") < 15).alias("cold_days"), F.count_if(F.col("temp_max") >= 35).alias("hot_days"),
    )


@query(f"SELECT * FROM (" + DAYS_ALL.replace("days AS (", "all_days AS (") + f", days AS (SELECT * FROM all_days WHERE date IN ('2024-01-19', '{TODAY}'))\n" + _everywhere(REGISTRY["win_day_over_day"][1], runs.DAYS_SQL) + f") WHERE date = '{TODAY}' AND temp_delta IS NOT NULL")
def compare_with_yesterday(spark, sf_dir, levels=LEVELS, place=None, date: str = TODAY):
    """A day against the one before; places without either have no row."""
    before = _shift(date, -1)[:10]
    both = days(spark, sf_dir, levels, place, _civil_day(before)[0], _civil_day(date)[1]).where(F.col("date").isin(before, date))
    return runs.day_over_day(both, PLACE).where((F.col("date") == date) & F.col("temp_delta").isNotNull())


@query(DAYS_ALL.replace("days AS (", "all_days AS (") + f", days AS (SELECT * FROM all_days WHERE date >= '{TODAY}' QUALIFY row_number() OVER (PARTITION BY level, place_id ORDER BY date) <= 7), several AS (SELECT level, place_id FROM days GROUP BY ALL HAVING count(avg_temp) > 1)\n" + _everywhere(REGISTRY["win_temp_trend"][1], runs.DAYS_SQL).replace("FROM days WHERE avg_temp IS NOT NULL", "FROM days JOIN several USING (level, place_id) WHERE avg_temp IS NOT NULL"))
def get_temperature_trend(spark, sf_dir, levels=LEVELS, place=None, n_days: int = 7):
    """Slope, turn and extremes of the next days; a place with one day has no trend."""
    nth, known = F.row_number().over(_by_place("date")), F.count("avg_temp").over(Window.partitionBy(*PLACE))
    rows = days(spark, sf_dir, levels, place, since=_civil_day(TODAY)[0]).where(F.col("date") >= TODAY).withColumn("nth", nth).where(F.col("nth") <= n_days)
    return runs.temp_trend(rows.withColumn("known", known).where("known > 1"), PLACE)


# ---------------------------------------------------------------- rankings


@query(f"SELECT district_name, value, ward_count, rank FROM ({REGISTRY['top_district_ranking'][1]}) WHERE metric = 'nhiet_do' AND \"order\" = 'cao_nhat'")
def get_district_ranking(spark, sf_dir, metric: str = "nhiet_do", order: str = "cao_nhat", limit: int = 5):
    return snapshot.ranking(snapshot.latest_groups(spark, sf_dir), metric, order == "cao_nhat", limit)


@query(f"SELECT district_id, ward_id, ts_utc, value, rank FROM ({REGISTRY['top_ward_ranking'][1]}) WHERE metric = 'nhiet_do' AND \"order\" = 'cao_nhat'")
def get_ward_ranking_in_district(spark, sf_dir, district: int | None = None, metric: str = "nhiet_do", order: str = "cao_nhat", limit: int = 10):
    """The first leaves of each group, or of one."""
    if metric not in snapshot.WARD_METRICS:
        raise ValueError(f"{metric} is none of {', '.join(snapshot.WARD_METRICS)}")
    ranked = snapshot.ward_ranking(spark, sf_dir, max(1, min(limit, 30))).where((F.col("metric") == metric) & (F.col("order") == order))
    return (ranked if district is None else ranked.where(F.col("district_id") == district)).select("district_id", "ward_id", "ts_utc", "value", "rank")


@query(REGISTRY["top_multi_compare"][1])
def get_district_multi_compare(spark, sf_dir, metrics: str = "nhiet_do,do_am,uvi", limit: int = 5):
    return snapshot.multi_compare(spark, sf_dir, metrics, limit)
