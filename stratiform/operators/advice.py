"""Scalar rules on observations: bands, indices, phenomena, alerts, activities and clothing, all table-driven."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions import bands
from stratiform.registry import REGISTRY, query
from stratiform.sources.roles import AS_OF, HOURLY_SQL, NEXT_DAY, NEXT_HOUR, hourly, rounded, shown, wards

TS = "strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc"
_WET = "('Rain', 'Drizzle', 'Thunderstorm')"


def _rowwise(name: str, doc: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """Registers columns of the hourly facts: each as a Column and as the oracle's SQL."""

    def run(spark, sf_dir):
        return hourly(spark, sf_dir).select("ward_id", shown("ts_utc").alias("ts_utc"), *[column().alias(k) for k, (column, _) in columns.items()])

    run.__name__, run.__doc__ = name, doc
    query(HOURLY_SQL + f"SELECT ward_id, {TS}, " + ", ".join(f"{sql} AS {k}" for k, (_, sql) in columns.items()) + " FROM hourly")(run)


def _band(column: str, table, closed: bool = False) -> tuple[Callable[[], Column], str]:
    return lambda: bands.banded(F.col(column), table, closed), bands.band_sql(column, table, closed)


def _scaled(column: str, factor: int, table) -> tuple[Callable[[], Column], str]:
    return lambda: bands.banded(F.col(column) * factor, table), bands.band_sql(f"({column} * {factor})", table)


_OCTANT_SQL = "CASE WHEN wind_deg IS NULL THEN 'Không xác định' ELSE ['Bắc', 'Đông Bắc', 'Đông', 'Đông Nam', 'Nam', 'Tây Nam', 'Tây', 'Tây Bắc'][(round_even((wind_deg % 360) / 45, 0)::INT % 8) + 1] END"
_BEAUFORT_SQL = "(" + " + ".join(f"(wind_speed >= {b})::INT" for b in bands.BEAUFORT) + ")"
_RothT = "(temp * 9 / 5 + 32)"
_HEAT_SQL = f"CASE WHEN temp >= 27 THEN (-42.379::DOUBLE + 2.04901523::DOUBLE * {_RothT} + 10.14333127::DOUBLE * humidity - 0.22475541::DOUBLE * {_RothT} * humidity - 0.00683783::DOUBLE * {_RothT} * {_RothT} - 0.05481717::DOUBLE * humidity * humidity + 0.00122874::DOUBLE * {_RothT} * {_RothT} * humidity + 0.00085282::DOUBLE * {_RothT} * humidity * humidity - 0.00000199::DOUBLE * {_RothT} * {_RothT} * humidity * humidity - 32) * 5 / 9 END"
_CHILL_SQL = "CASE WHEN temp <= 10 AND wind_speed > 1.3 THEN 13.12::DOUBLE + 0.6215::DOUBLE * temp - 11.37::DOUBLE * pow(wind_speed * 3.6::DOUBLE, 0.16) + 0.3965::DOUBLE * temp * pow(wind_speed * 3.6::DOUBLE, 0.16) END"
_COMFORT_SQL = """greatest(0.0, least(100.0, round_even(round(100 - CASE WHEN temp < 10 THEN (10 - temp) * 5 WHEN temp < 15 THEN (15 - temp) * 4 WHEN temp < 22 THEN (22 - temp) * 1.5::DOUBLE WHEN temp <= 28 THEN 0 WHEN temp <= 32 THEN (temp - 28) * 2 WHEN temp <= 35 THEN (temp - 28) * 3 ELSE (temp - 28) * 5 END
 - CASE WHEN humidity > 90 THEN (humidity - 70) * 0.8::DOUBLE WHEN humidity > 80 THEN (humidity - 70) * 0.5::DOUBLE WHEN humidity > 70 THEN (humidity - 70) * 0.3::DOUBLE ELSE 0 END
 - CASE WHEN wind_speed > 15 THEN (wind_speed - 6) * 3 WHEN wind_speed > 10 THEN (wind_speed - 6) * 2 WHEN wind_speed > 6 THEN wind_speed - 6 ELSE 0 END
 - CASE WHEN uvi > 10 THEN (uvi - 6) * 3 WHEN uvi > 8 THEN (uvi - 6) * 2.5::DOUBLE WHEN uvi > 6 THEN (uvi - 6) * 1.5::DOUBLE ELSE 0 END
 - CASE WHEN pop > 0.7 THEN pop * 30 WHEN pop > 0.5 THEN pop * 20 WHEN pop > 0.3 THEN pop * 10 ELSE 0 END, 6), 0)))::DOUBLE"""

_rowwise("fn_bucket_label", "Bands of rain, chance, clouds and temperature.", {"rain": _band("rain_1h", bands.RAIN_HOUR), "chance": _scaled("pop", 100, bands.CHANCE), "sky": _band("clouds", bands.CLOUDS), "warmth": _band("temp", bands.TEMPERATURE)})
_rowwise("fn_wind_octant", "Direction by name.", {"direction": (lambda: bands.octant(F.col("wind_deg")), _OCTANT_SQL)})
_rowwise("fn_beaufort", "Wind force.", {"force": (lambda: bands.beaufort(F.col("wind_speed")), _BEAUFORT_SQL)})
_rowwise("fn_uv_status", "UV band.", {"uv": _band("uvi", bands.UV, True)})
_rowwise("fn_uv_level_daily", "UV band of daily summaries.", {"uv": _band("uvi", bands.UV_DAILY)})
_rowwise("fn_dew_status", "Dew point band.", {"dew": _band("dew_point", bands.DEW)})
_rowwise("fn_dew_status_agg", "Dew point band of groups.", {"dew": _band("dew_point", bands.DEW_GROUP, True)})
_rowwise("fn_pressure_status", "Pressure band.", {"status": _band("pressure", bands.PRESSURE)})
_rowwise("fn_heat_index", "Heat index and its level; null where it does not apply.", {
    "heat_index": (lambda: rounded(bands.heat_index(F.col("temp"), F.col("humidity")), 1), f"round({_HEAT_SQL} + 1e-9, 1)"),
    "level": (lambda: bands.banded(rounded(bands.heat_index(F.col("temp"), F.col("humidity")), 6), bands.HEAT_LEVELS, missing=None), bands.band_sql(f"round({_HEAT_SQL} + 1e-9, 6)", bands.HEAT_LEVELS, missing=None)),
})
_rowwise("fn_wind_chill", "Wind chill and its level; null where it does not apply.", {
    "wind_chill": (lambda: rounded(bands.wind_chill(F.col("temp"), F.col("wind_speed")), 1), f"round({_CHILL_SQL} + 1e-9, 1)"),
    "level": (lambda: bands.banded(rounded(bands.wind_chill(F.col("temp"), F.col("wind_speed")), 6), bands.CHILL_LEVELS, True, None), bands.band_sql(f"round({_CHILL_SQL} + 1e-9, 6)", bands.CHILL_LEVELS, True, None)),
})
def _comfort() -> Column:
    return bands.comfort(F.col("temp"), F.col("humidity"), F.col("wind_speed"), F.col("uvi"), F.col("pop"))


_rowwise("fn_comfort_index", "Comfort score and label.", {"score": (_comfort, _COMFORT_SQL), "label": (lambda: bands.banded(_comfort(), bands.COMFORT_LEVELS), bands.band_sql(_COMFORT_SQL, bands.COMFORT_LEVELS))})
_rowwise("fn_dew_magnus", "Dew point from temperature and humidity; null without humidity.", {"dew": (
    lambda: rounded(F.when(F.col("humidity") > 0, 243.04 * (F.log(F.col("humidity") / 100.0) + 17.625 * F.col("temp") / (243.04 + F.col("temp"))) / (17.625 - F.log(F.col("humidity") / 100.0) - 17.625 * F.col("temp") / (243.04 + F.col("temp")))), 2),
    "round(CASE WHEN humidity > 0 THEN 243.04::DOUBLE * (ln(humidity / 100.0::DOUBLE) + 17.625::DOUBLE * temp / (243.04::DOUBLE + temp)) / (17.625::DOUBLE - ln(humidity / 100.0::DOUBLE) - 17.625::DOUBLE * temp / (243.04::DOUBLE + temp)) END + 1e-9, 2)",
)})
_rowwise("fn_dew_depression", "How humid the air feels.", {"feels": (lambda: F.when(F.col("temp") - F.col("dew_point") < 3, "ẩm rõ rệt").when(F.col("temp") - F.col("dew_point") < 7, "hơi ẩm").otherwise("khô thoáng"), "CASE WHEN temp - dew_point < 3 THEN 'ẩm rõ rệt' WHEN temp - dew_point < 7 THEN 'hơi ẩm' ELSE 'khô thoáng' END")})
_rowwise("fn_visibility_band", "Visibility in kilometres, by band; null at 0 and below.", {"band": (lambda: F.when(F.col("visibility") <= 0, F.lit(None)).when(F.col("visibility") < 1000, "<1").when(F.col("visibility") < 3000, "<3").when(F.col("visibility") < 5000, "<5").otherwise(">=5"), "CASE WHEN visibility <= 0 THEN NULL WHEN visibility < 1000 THEN '<1' WHEN visibility < 3000 THEN '<3' WHEN visibility < 5000 THEN '<5' ELSE '>=5' END")})
_rowwise("fn_wind_text", "Wind as text; the gust only if it is well above the speed.", {"wind": (
    lambda: F.concat_ws(" ", F.concat(F.lit("cấp "), bands.beaufort(F.col("wind_speed")).cast("string")), F.format_number("wind_speed", 1), F.when(F.col("wind_gust") > F.col("wind_speed") + 0.5, F.concat(F.lit("giật "), F.format_number("wind_gust", 1)))),
    f"concat_ws(' ', 'cấp ' || {_BEAUFORT_SQL}::VARCHAR, printf('%.1f', wind_speed), CASE WHEN wind_gust > wind_speed + 0.5 THEN 'giật ' || printf('%.1f', wind_gust) END)",
)})
_rowwise("str_weather_summary", "Warmth, condition, high humidity and wind in one text.", {"summary": (
    lambda: F.concat_ws(", ", F.when(F.col("temp") < 15, "lạnh").when(F.col("temp") < 25, "mát").when(F.col("temp") < 32, "nóng").otherwise("rất nóng"), "weather_main", F.when(F.col("humidity") >= 85, "độ ẩm cao"), bands.octant(F.col("wind_deg"))),
    f"concat_ws(', ', CASE WHEN temp < 15 THEN 'lạnh' WHEN temp < 25 THEN 'mát' WHEN temp < 32 THEN 'nóng' ELSE 'rất nóng' END, weather_main, CASE WHEN humidity >= 85 THEN 'độ ẩm cao' END, {_OCTANT_SQL})",
)})

# Month, mean temperature, humidity, rainy days.
CLIMATE = ((1, 17, 75, 6), (2, 19, 78, 8), (3, 22, 80, 12), (4, 27, 82, 15), (5, 30, 80, 18), (6, 31, 78, 16), (7, 31, 76, 14), (8, 30, 80, 17), (9, 29, 79, 14), (10, 26, 76, 10), (11, 22, 74, 7), (12, 18, 73, 5))
_CLIMATE_SQL = "(VALUES " + ", ".join(map(str, CLIMATE)) + ") AS c(month, mean_temp, mean_humidity, rain_days)"


@query(HOURLY_SQL + f"SELECT ward_id, {TS}, CASE WHEN temp - mean_temp > 3 THEN 'warmer' WHEN temp - mean_temp < -3 THEN 'colder' ELSE 'usual' END AS warmth, CASE WHEN humidity - mean_humidity > 10 THEN 'damper' WHEN humidity - mean_humidity < -10 THEN 'drier' ELSE 'usual' END AS damp FROM hourly JOIN {_CLIMATE_SQL} ON month(hourly.ts_utc) = c.month")
def fn_seasonal_compare(spark, sf_dir):
    climate = F.broadcast(spark.createDataFrame(CLIMATE, "month int, mean_temp int, mean_humidity int, rain_days int"))  # twelve rows
    t, h = F.col("temp") - F.col("mean_temp"), F.col("humidity") - F.col("mean_humidity")
    rows = hourly(spark, sf_dir).withColumn("month", F.month("ts_utc")).join(climate, "month")
    return rows.select("ward_id", shown("ts_utc").alias("ts_utc"), F.when(t > 3, "warmer").when(t < -3, "colder").otherwise("usual").alias("warmth"), F.when(h > 10, "damper").when(h < -10, "drier").otherwise("usual").alias("damp"))


@query(f"SELECT DISTINCT user_id AS ward_id, c.month::INT AS month, mean_temp::INT AS mean_temp, mean_humidity::INT AS mean_humidity, rain_days::INT AS rain_days FROM events JOIN {_CLIMATE_SQL} ON c.month = month(ts)")
def fn_seasonal_lookup(spark, sf_dir):
    """The usual values of each month in which a leaf has rows: a join with twelve literal rows."""
    usual = spark.createDataFrame(CLIMATE, "month int, mean_temp int, mean_humidity int, rain_days int")
    months = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("ward_id"), F.month("ts").alias("month")).distinct()
    return months.join(F.broadcast(usual), "month").select("ward_id", "month", "mean_temp", "mean_humidity", "rain_days")


# Fixed values.
#: Phenomena: name, severity and condition; of conditions with the same name the first that holds counts.
PHENOMENA = (
    ("nom_am", "high", "m IN (2, 3, 4) AND humidity >= 95 AND temp - dew_point <= 2"),
    ("nom_am", "medium", "m IN (2, 3, 4) AND humidity >= 85 AND temp - dew_point <= 3"),
    ("gio_lao", "high", "m IN (5, 6, 7, 8) AND wind_deg BETWEEN 180 AND 270 AND wind_speed > 5 AND humidity < 55"),
    ("gio_tay", "medium", "m IN (5, 6, 7, 8) AND wind_deg BETWEEN 180 AND 270 AND wind_speed > 5 AND humidity >= 55"),
    ("gio_dong_bac", "medium", "m IN (10, 11, 12, 1, 2, 3) AND wind_speed > 5 AND (wind_deg >= 315 OR wind_deg <= 90)"),
    ("ret_dam", "high", "m IN (11, 12, 1, 2, 3) AND temp < 13 AND clouds >= 70"),
    ("ret_dam", "medium", "m IN (11, 12, 1, 2, 3) AND temp < 15 AND clouds >= 70"),
    ("ret_nhe", "low", "m IN (11, 12, 1, 2, 3) AND temp < 15 AND clouds < 70"),
    ("ret_nang_ban", "medium", "m = 3 AND temp < 18 AND humidity > 80"),
    ("nang_nong", "high", "m IN (5, 6, 7, 8, 9) AND temp >= 39"),
    ("nang_nong", "medium", "m IN (5, 6, 7, 8, 9) AND temp >= 37"),
    ("nang_nong", "low", "m IN (5, 6, 7, 8, 9) AND temp >= 35"),
    ("suong_mu", "high", "visibility < 200"),
    ("suong_mu", "medium", "visibility < 1000 AND (m IN (1, 2) OR (m = 3 AND temp < 20))"),
    ("mua_dong", "high", "m BETWEEN 4 AND 10 AND weather_main = 'Thunderstorm'"),
)
_NAMES = tuple(dict.fromkeys(name for name, _, _ in PHENOMENA))
_SEVERITY = {name: "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for n, s, c in PHENOMENA if n == name) + " END" for name in _NAMES}


@query(HOURLY_SQL + ", h AS (SELECT *, month(ts_utc) AS m FROM hourly) " + " UNION ALL ".join(f"SELECT ward_id, {TS}, '{n}' AS kind, {_SEVERITY[n]} AS severity FROM h WHERE {_SEVERITY[n]} IS NOT NULL" for n in _NAMES))
def fn_phenomena(spark, sf_dir):
    hits = F.array_compact(F.array(*[F.when(F.expr(_SEVERITY[n]).isNotNull(), F.struct(F.lit(n).alias("kind"), F.expr(_SEVERITY[n]).alias("severity"))) for n in _NAMES]))
    return hourly(spark, sf_dir).withColumn("m", F.month("ts_utc")).select("ward_id", shown("ts_utc").alias("ts_utc"), F.explode(hits).alias("hit")).select("ward_id", "ts_utc", "hit.kind", "hit.severity")


# Alert and its condition.
ALERTS = (("wind", "wind_gust > 20"), ("cold", "temp < 13"), ("heat", "temp > 39"), ("thunderstorm", "weather_main = 'Thunderstorm'"))
_NEXT = f"ts_utc > TIMESTAMP '{AS_OF}' AND ts_utc < TIMESTAMP '{AS_OF}' + INTERVAL 24 HOURS"


def alerts(facts: DataFrame) -> DataFrame:
    """A row for each rule that a forecast hour of the next day breaks."""
    hits = F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in ALERTS]))
    return facts.where(_NEXT).select("district_id", "ward_id", shown("ts_utc").alias("ts_utc"), F.explode(hits).alias("alert"))


_ALERTS_SQL = ", next AS (SELECT * FROM placed WHERE data_kind = 'forecast' AND ts_utc > TIMESTAMP '2024-01-20 06:00:00' AND ts_utc < TIMESTAMP '2024-01-21 06:00:00' AND ward_id IN (SELECT min(c_custkey) FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey)), found AS (" + " UNION ALL ".join(f"SELECT district_id, ward_id, {TS}, '{n}' AS alert FROM next WHERE {c}" for n, c in (("wind", "wind_gust > 20"), ("cold", "temp < 13"), ("heat", "temp > 39"), ("thunderstorm", "weather_main = 'Thunderstorm'"))) + ")\n"


def representative_facts(spark, sf_dir) -> DataFrame:
    """The forecast of the next day of each group's representative leaf, the one of least id."""
    chosen = wards(spark, sf_dir).where("district_id IS NOT NULL").groupBy("district_id").agg(F.min("ward_id").alias("ward_id"))
    facts = hourly(spark, sf_dir, NEXT_HOUR, NEXT_DAY).where("data_kind = 'forecast'").join(F.broadcast(chosen), "ward_id")  # a leaf for each of a few dozen groups
    return facts


@query(HOURLY_SQL + _ALERTS_SQL + "SELECT * FROM found")
def fn_alert_rules(spark, sf_dir):
    return alerts(representative_facts(spark, sf_dir))


@query(HOURLY_SQL + _ALERTS_SQL + "SELECT district_id, alert, count(*) AS n_alerts, count(DISTINCT ward_id) AS n_wards, min(ts_utc) AS first_ts FROM found GROUP BY ALL")
def fn_alerts_grouped(spark, sf_dir):
    return alerts(representative_facts(spark, sf_dir)).groupBy("district_id", "alert").agg(F.count(F.lit(1)).alias("n_alerts"), F.count_distinct("ward_id").alias("n_wards"), F.min("ts_utc").alias("first_ts"))


# Activity, temperature range, most chance of rain, UV, wind, humidity (null: no limit).
ACTIVITIES = (
    ("chay_bo", 15, 25, 0.2, 6, 5, None), ("dua_dieu", 20, 30, 0.2, 8, 5, None), ("picnic", 22, 28, 0.1, 7, 3, None), ("bike", 18, 28, 0.2, 7, 5, None), ("chup_anh", 15, 32, 0.2, 10, 8, None),
    ("tap_the_duc", 18, 25, 0.2, 6, 5, None), ("phoi_do", 20, 40, 0.1, 99, 10, 75), ("du_lich", 20, 32, 0.2, 8, 8, None), ("cam_trai", 18, 30, 0.1, 8, 6, None), ("cau_ca", 15, 35, 0.3, 9, 7, None),
    ("lam_vuon", 18, 32, 0.2, 8, 5, None), ("boi_loi", 28, 38, 0.3, 10, 10, None), ("leo_nui", 15, 30, 0.1, 8, 8, None), ("di_dao", 18, 32, 0.2, 8, 6, None), ("su_kien", 20, 32, 0.1, 7, 5, None),
)
_ACTIVITY_SQL = "(VALUES " + ", ".join("('%s', %s, %s, %s, %s, %s, %s)" % tuple("NULL" if v is None else v for v in a) for a in ACTIVITIES) + ") AS a(activity, low, high, pop_max, uv_max, wind_max, humidity_max)"
_SCORE = """greatest(0, round_even(round(100 - CASE WHEN temp < low THEN least(30, (low - temp) * 5) WHEN temp > high THEN least(30, (temp - high) * 5) ELSE 0 END
 - CASE WHEN pop > pop_max THEN least(40, pop * 50) ELSE 0 END - CASE WHEN uvi > uv_max THEN least(20, (uvi - uv_max) * 5) ELSE 0 END
 - CASE WHEN wind_speed > wind_max THEN least(20, (wind_speed - wind_max) * 5) ELSE 0 END - CASE WHEN humidity > humidity_max THEN least(15, (humidity - humidity_max) * 0.5) ELSE 0 END, 6), 0))"""
_SCORED_SQL = HOURLY_SQL + f", f AS (SELECT * FROM hourly WHERE ts_utc > TIMESTAMP '{AS_OF}' AND temp IS NOT NULL), scored AS (SELECT activity, ward_id, {TS}, {_SCORE}::DOUBLE AS score FROM f, {_ACTIVITY_SQL})\n"


def scored(rows: DataFrame, keys: list[str], activities=None) -> DataFrame:
    """A score from 100 down for each activity and row with a temperature; the activities are an array on the row.

    An activity that the table does not have is judged as a run is.
    """
    known = {a[0]: a[1:] for a in ACTIVITIES}
    number = lambda v: F.lit(None if v is None else float(v)).cast("double")
    chosen = [(a, known.get(a, known["chay_bo"])) for a in (activities or known)]
    rules = F.array(*[F.struct(F.lit(a).alias("activity"), *[number(v).alias(k) for k, v in zip(("low", "high", "pop_max", "uv_max", "wind_max", "humidity_max"), limits, strict=True)]) for a, limits in chosen])
    spread = rows.where("temp IS NOT NULL").withColumn("rule", F.explode(rules)).select(*keys, "ts_utc", "temp", "pop", "uvi", "wind_speed", "humidity", "rule.*")
    score = F.expr(_SCORE.replace("round_even(", "bround(").replace("ELSE 0 END", "ELSE 0D END").replace("0.5", "0.5D"))
    return spread.select("activity", *keys, "ts_utc", score.cast("double").alias("score"))


def activity_scores(spark, sf_dir) -> DataFrame:
    return scored(hourly(spark, sf_dir, NEXT_HOUR).withColumn("ts_utc", shown("ts_utc")), ["ward_id"])


def best_and_worst(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The five best rows of each activity, and the three worst where there are more than three."""
    own = Window.partitionBy("activity", *keys)
    ranked = scores.withColumn("nth", F.row_number().over(own.orderBy(F.desc("score"), "ts_utc"))).withColumn("n", F.count(F.lit(1)).over(own))
    sides = F.array_compact(F.array(F.when(F.col("nth") <= 5, "best"), F.when((F.col("n") > 3) & (F.col("nth") > F.col("n") - 3), "worst")))
    return ranked.select(*keys, "activity", F.explode(sides).alias("side"), "ts_utc", "score")


@query(_SCORED_SQL + "SELECT * FROM scored")
def fn_activity_score(spark, sf_dir):
    return activity_scores(spark, sf_dir)


@query(_SCORED_SQL + """SELECT ward_id, activity, side, ts_utc, score
FROM (SELECT *, row_number() OVER (PARTITION BY activity, ward_id ORDER BY score DESC, ts_utc) AS nth, count(*) OVER (PARTITION BY activity, ward_id) AS n FROM scored), (VALUES ('best'), ('worst')) AS v(side)
WHERE (side = 'best' AND nth <= 5) OR (side = 'worst' AND n > 3 AND nth > n - 3)""")
def top_best_hours(spark, sf_dir):
    return best_and_worst(activity_scores(spark, sf_dir), ["ward_id"])


#: The same query under a second name that earlier callers use.
REGISTRY["top_best_worst_hours"] = REGISTRY["top_best_hours"]

LIMITS = ("temp_danger", "temp_high", "temp_low", "uv_danger", "uv_high", "pop_danger", "pop_high", "wind_low", "wind_danger", "wind_high", "humidity_high", "clouds_low", "clouds_high")
# Activity profile and its limits in that order (null: no limit); the last stands for all other activities.
PROFILES = (
    ("chay_bo", 32, 28, None, 8, 5, None, 0.4, None, None, 8, 80, None, None), ("chup_anh", None, None, None, None, 8, None, 0.5, None, None, 10, None, 30, 70),
    ("picnic", None, 32, 15, None, 8, None, 0.3, None, None, 7, 85, None, None), ("di_dao", None, 33, 12, None, 8, None, 0.5, None, None, 11, 90, None, None),
    ("dua_dieu", None, None, None, None, None, None, 0.3, 2, 14, 11, None, None, None), ("cau_ca", None, None, None, None, 9, None, 0.5, None, None, 8, None, None, None),
    ("boi_loi", None, None, 22, None, 8, None, 0.3, None, None, 10, None, None, None), ("su_kien", None, 33, None, None, 8, 0.5, 0.2, None, 16, 10, None, None, None),
    ("khac", None, 33, 12, None, 8, None, 0.5, None, None, 12, 90, None, None),
)
#: Issue, severity (1 warning, 2 danger), condition on the readings and a profile's limits; missing readings of rain, UV and wind count as 0.
ISSUES = (
    ("heat", 2, "temp >= temp_danger"), ("hot", 1, "temp >= temp_high AND NOT coalesce(temp >= temp_danger, false)"), ("cold", 1, "temp <= temp_low"),
    ("uv_danger", 2, "coalesce(uvi, 0) >= uv_danger"), ("uv", 1, "coalesce(uvi, 0) >= uv_high AND NOT coalesce(coalesce(uvi, 0) >= uv_danger, false)"),
    ("rain_danger", 2, "coalesce(pop, 0) >= pop_danger"), ("rain", 1, "coalesce(pop, 0) >= pop_high AND NOT coalesce(coalesce(pop, 0) >= pop_danger, false)"),
    ("calm", 1, "coalesce(wind_speed, 0) < wind_low"), ("gale", 2, "greatest(coalesce(wind_speed, 0), coalesce(wind_gust, 0)) >= wind_danger"),
    ("wind", 1, "greatest(coalesce(wind_speed, 0), coalesce(wind_gust, 0)) >= wind_high AND NOT coalesce(greatest(coalesce(wind_speed, 0), coalesce(wind_gust, 0)) >= wind_danger, false)"),
    ("humid", 1, "humidity >= humidity_high"), ("glare", 1, "clouds < clouds_low"), ("dull", 1, "clouds > clouds_high"), ("storm", 2, "weather_main = 'Thunderstorm'"),
)


def activity_advice(rows: DataFrame, activities=None) -> DataFrame:
    """`rows` of readings with a row for each activity: its issues, their greatest severity and the verdict.

    An activity without a profile of its own gets the last one; the profiles are an array on the row.
    """
    known = {p[0]: p[1:] for p in PROFILES}
    number = lambda v: F.lit(None if v is None else float(v)).cast("double")
    chosen = [(a, known.get(a, known["khac"])) for a in (activities or known)]
    rules = F.array(*[F.struct(F.lit(a).alias("activity"), *[number(v).alias(k) for k, v in zip(LIMITS, limits, strict=True)]) for a, limits in chosen])
    found = F.array_compact(F.array(*[F.when(F.expr(c), n) for n, _, c in ISSUES]))
    worst = F.greatest(*[F.when(F.expr(c), severity).otherwise(0) for _, severity, c in ISSUES])
    out = rows.withColumn("__rule", F.explode(rules)).select("*", "__rule.*").withColumns({"__found": found, "severity": worst})
    verdict = F.when(F.col("severity") == 2, "khong_nen").when((F.col("severity") == 1) & (F.size("__found") >= 3), "han_che").when(F.col("severity") == 1, "co_the").otherwise("nen")
    return out.withColumns({"issues": F.array_join("__found", ", "), "verdict": verdict}).drop("__rule", "__found", *LIMITS)


def advice_sql(source: str, columns: str) -> str:
    """The same by a join with the table of limits and one condition after the other."""
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in PROFILES)
    tests = (
        "CASE WHEN temp >= temp_danger THEN 'heat' WHEN temp >= temp_high THEN 'hot' END", "CASE WHEN temp <= temp_low THEN 'cold' END", "CASE WHEN coalesce(uvi, 0) >= uv_danger THEN 'uv_danger' WHEN coalesce(uvi, 0) >= uv_high THEN 'uv' END",
        "CASE WHEN coalesce(pop, 0) >= pop_danger THEN 'rain_danger' WHEN coalesce(pop, 0) >= pop_high THEN 'rain' END", "CASE WHEN coalesce(wind_speed, 0) < wind_low THEN 'calm' END",
        "CASE WHEN greatest(coalesce(wind_speed, 0), coalesce(wind_gust, 0)) >= wind_danger THEN 'gale' WHEN greatest(coalesce(wind_speed, 0), coalesce(wind_gust, 0)) >= wind_high THEN 'wind' END",
        "CASE WHEN humidity >= humidity_high THEN 'humid' END", "CASE WHEN clouds < clouds_low THEN 'glare' WHEN clouds > clouds_high THEN 'dull' END", "CASE WHEN weather_main = 'Thunderstorm' THEN 'storm' END",
    )
    return f""", limits AS (SELECT activity, {', '.join(f'{k}::DOUBLE AS {k}' for k in LIMITS)} FROM (VALUES {values}) AS v(activity, {', '.join(LIMITS)})),
tested AS (SELECT *, list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL) AS found FROM {source}, limits),
ranked AS (SELECT *, CASE WHEN list_has_any(found, ['heat', 'uv_danger', 'rain_danger', 'gale', 'storm']) THEN 2 WHEN len(found) > 0 THEN 1 ELSE 0 END AS severity FROM tested)
SELECT {columns}, activity, array_to_string(found, ', ') AS issues, severity::INT AS severity, CASE severity WHEN 2 THEN 'khong_nen' WHEN 0 THEN 'nen' ELSE CASE WHEN len(found) >= 3 THEN 'han_che' ELSE 'co_the' END END AS verdict FROM ranked"""


_NEXT_FACTS = HOURLY_SQL + f", next AS (SELECT * FROM hourly WHERE ts_utc > TIMESTAMP '{AS_OF}')"


@query(f"SELECT ward_id, ts_utc, activity, issues, severity FROM (" + _NEXT_FACTS + advice_sql("next", f"ward_id, {TS}") + ")")
def fn_activity_profile_eval(spark, sf_dir):
    """Issues of each activity in each forecast hour and their greatest severity."""
    return activity_advice(hourly(spark, sf_dir, NEXT_HOUR)).select("ward_id", shown("ts_utc").alias("ts_utc"), "activity", "issues", "severity")


@query(f"SELECT ward_id, ts_utc, activity, verdict FROM (" + _NEXT_FACTS + advice_sql("next", f"ward_id, {TS}") + ")")
def fn_activity_verdict(spark, sf_dir):
    return activity_advice(hourly(spark, sf_dir, NEXT_HOUR)).select("ward_id", shown("ts_utc").alias("ts_utc"), "activity", "verdict")


# Fixed values.
#: Clothing: items and notes with their conditions, in the order in which they are told. `wind` is the wind that counts.
CLOTHING = (
    ("Áo phao/áo khoác dày", "temp < 10"), ("Khăn quàng cổ", "temp < 10"), ("Găng tay", "temp < 10"), ("Mũ len", "temp < 10"),
    ("Áo khoác dày", "temp >= 10 AND temp < 15"), ("Áo len", "temp >= 10 AND temp < 15"), ("Quần dài", "temp >= 10 AND temp < 15"),
    ("Áo khoác nhẹ", "temp >= 15 AND temp < 20"), ("Áo dài tay", "temp >= 15 AND temp < 20"),
    ("Áo thun dài tay hoặc ngắn tay", "temp >= 20 AND temp < 25"), ("Quần dài hoặc short", "temp >= 20 AND temp < 25"),
    ("Áo mỏng thoáng", "temp >= 25 AND temp < 32"), ("Quần short", "temp >= 25 AND temp < 32"), ("Mũ chống nắng", "temp >= 25 AND temp < 32"),
    ("Áo mỏng thoáng mát nhất", "temp >= 32"), ("Mũ rộng vành", "temp >= 32"), ("Kính râm", "temp >= 32"),
    ("Ô/áo mưa", "pop > 0.5 OR wet"), ("Ô gấp nhỏ", "pop > 0.3 AND NOT (pop > 0.5 OR wet)"),
    ("Kem chống nắng SPF50+", "uvi >= 8"), ("Kính râm", "uvi >= 8 AND temp < 32"), ("Kem chống nắng SPF30+", "uvi >= 5 AND uvi < 8"),
)
CLOTHING_NOTES = (
    ("Rét đậm - mặc nhiều lớp, giữ ấm cổ và tay", "temp < 10"), ("Lạnh - nên mặc áo khoác dày", "temp >= 10 AND temp < 15"), ("Se lạnh - áo khoác nhẹ là đủ", "temp >= 15 AND temp < 20"),
    ("Nóng - chọn vải thoáng mát", "temp >= 25 AND temp < 32"), ("Rất nóng - hạn chế ra ngoài, uống nhiều nước", "temp >= 32"),
    ("Có mưa - nhớ mang ô", "pop > 0.5 OR wet"), ("Có thể mưa - mang ô phòng", "pop > 0.3 AND NOT (pop > 0.5 OR wet)"), ("Nồm ẩm - tránh vải cotton, chọn vải nhanh khô", "humidity > 90 AND temp > 20"),
    ("UV rất cao - bảo vệ da", "uvi >= 8"), ("Gió mạnh - tránh áo rộng, chọn áo sát người", "wind > 8"),
)
#: What stands for a reading that is missing.
_WORN = {"pop": "coalesce(pop, 0)", "uvi": "coalesce(uvi, 0)", "humidity": "coalesce(humidity, 50)", "wet": f"coalesce(weather_main IN {_WET}, false)"}


def _told(rules, wind: str) -> list[tuple[str, str]]:
    """Conditions by text, over the readings as they stand, missing ones replaced; `wind` is the wind that counts, as SQL."""
    filled = _WORN | {"wind": wind}
    return [(text, re.sub(r"\b(pop|uvi|humidity|wet|wind)\b", lambda m: filled[m[0]], rule)) for text, rule in rules]


def clothing(rules=None, wind: str = "coalesce(wind_speed, 0)") -> Column:
    """The items, or with CLOTHING_NOTES the notes, joined; null where there is no temperature."""
    found = F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in _told(rules or CLOTHING, wind)])), "; ")
    return F.when(F.col("temp").isNotNull(), found)


def clothing_sql(rules=None, wind: str = "coalesce(wind_speed, 0)") -> str:
    return "CASE WHEN temp IS NOT NULL THEN array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _told(rules or CLOTHING, wind)) + "], lambda x: x IS NOT NULL), '; ') END"


#: Gusts count where there is no more than advice for a place.
GUSTS = "greatest(coalesce(wind_speed, 0), coalesce(wind_gust, 0))"
_rowwise("fn_clothing", "What to wear and what to mind, joined.", {"items": (clothing, clothing_sql()), "notes": (lambda: clothing(CLOTHING_NOTES), clothing_sql(CLOTHING_NOTES))})
