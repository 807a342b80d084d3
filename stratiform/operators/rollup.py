"""Roll-ups from leaves to groups and regions, hourly and daily, with mode, circular mean and extent."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.sources.roles import AS_OF, CIVIL_HOURS, HOURLY_SQL, NEXT_DAY, NEXT_HOUR, civil, hourly, placed, rounded, shown
from stratiform.registry import query

#: Rain of an hour and of a day from which a leaf counts as rainy (mm).
RAINY_HOUR, RAINY_DAY = 0.5, 1.0


def circular_mean(degrees: str) -> Column:
    """Mean direction in [0, 360), one decimal."""
    angle = F.radians(degrees)
    return F.pmod(rounded(F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))) + 360, 1), F.lit(360.0))


def mode_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the most frequent value, nulls included; of equally frequent ones the smallest.

    Counted first, then the best of each key by a partial aggregate: no key's rows are gathered.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias(value))


@dataclass(frozen=True)
class Shape:
    """What a roll-up holds: means (result: reading and digits), extremes (result: reading), and the rule of a rainy row.

    `state` are sums, counts and extremes of rows that share a condition. States of parts of the rows can be put together
    by `merge`, in any order and number, and `result` makes the roll-up of them.
    """

    means: dict[str, tuple[str, int]]
    least: dict[str, str]
    most: dict[str, str]
    rainy: str

    @property
    def readings(self) -> list[str]:
        return sorted({c for c, _ in self.means.values()})

    def state(self) -> list[Column]:
        angle = F.radians("wind_deg")
        return [
            F.count(F.lit(1)).alias("n"), F.count("ward_id").alias("wards"), F.count_if(F.expr(self.rainy)).alias("rainy"),
            F.sum(F.sin(angle)).alias("sin"), F.sum(F.cos(angle)).alias("cos"), F.count("wind_deg").alias("angles"),
            *[F.sum(c).alias(f"sum_{c}") for c in self.readings], *[F.count(c).alias(f"count_{c}") for c in self.readings],
            *[F.min(c).alias(name) for name, c in self.least.items()], *[F.max(c).alias(name) for name, c in self.most.items()],
        ]

    def merge(self) -> list[Column]:
        sums = ["n", "wards", "rainy", "sin", "cos", "angles", *[f"{kind}_{c}" for kind in ("sum", "count") for c in self.readings]]
        return [*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in self.least], *[F.max(c).alias(c) for c in self.most]]

    def result(self) -> list[Column]:
        """Means, extremes, extent, mean direction, and the mode of the condition: the most frequent one, nulls included, of
        equally frequent ones the smallest. There must be one state for each condition."""
        direction = F.degrees(F.atan2(F.sum("sin") / F.sum("angles"), F.sum("cos") / F.sum("angles")))
        return [
            *[rounded(F.sum(f"sum_{c}") / F.sum(f"count_{c}"), n).alias(name) for name, (c, n) in self.means.items()],
            *[F.min(name).alias(name) for name in self.least], *[F.max(name).alias(name) for name in self.most],
            F.sum("rainy").alias("rainy_ward_count"), F.sum("wards").alias("ward_count"), F.pmod(rounded(direction + 360, 1), F.lit(360.0)).alias("avg_wind_deg"),
            F.min_by("weather_main", F.struct((-F.col("n")).alias("n"), F.col("weather_main").alias("v"))).alias("weather_main"),
        ]


def rolled(facts: DataFrame, keys: list[str], shape: Shape) -> DataFrame:
    """The roll-up of each key from one pass over `facts`, which has a row for each leaf and instant.

    Counts and sums are taken by key and condition first; the few rows that a key then has give its means and its mode.
    Both steps combine before they shuffle.
    """
    return facts.groupBy(*keys, "weather_main").agg(*shape.state()).groupBy(*keys).agg(*shape.result())


HOURLY = Shape(
    {
        "avg_temp": ("temp", 2), "avg_humidity": ("humidity", 1), "avg_wind_speed": ("wind_speed", 2), "avg_dew_point": ("dew_point", 2), "avg_pressure": ("pressure", 1), "avg_clouds": ("clouds", 1),
        "avg_visibility": ("visibility", 0), "avg_uvi": ("uvi", 2), "avg_pop": ("pop", 3), "avg_rain_1h": ("rain_1h", 2),
    },
    {"min_temp": "temp"}, {"max_temp": "temp", "max_rain_1h": "rain_1h", "max_pop": "pop", "max_wind_gust": "wind_gust", "max_uvi": "uvi"}, f"rain_1h > {RAINY_HOUR}",
)


def hourly_rollup(facts: DataFrame, key: str) -> DataFrame:
    return rolled(facts, [key, "ts_utc"], HOURLY)


def _hourly_sql(key: str, where: str = "TRUE") -> str:
    return HOURLY_SQL + f""", modes AS (
  SELECT {key}, ts_utc, weather_main FROM placed WHERE {where} GROUP BY {key}, ts_utc, weather_main
  QUALIFY row_number() OVER (PARTITION BY {key}, ts_utc ORDER BY count(*) DESC, weather_main) = 1)
SELECT {key}, strftime(ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, round(avg(temp) + 1e-9, 2) AS avg_temp, min(temp) AS min_temp, max(temp) AS max_temp,
  round(avg(humidity) + 1e-9, 1) AS avg_humidity, round(avg(wind_speed) + 1e-9, 2) AS avg_wind_speed, round(avg(dew_point) + 1e-9, 2) AS avg_dew_point, round(avg(pressure) + 1e-9, 1) AS avg_pressure,
  round(avg(clouds) + 1e-9, 1) AS avg_clouds, round(avg(visibility) + 1e-9, 0) AS avg_visibility, round(avg(uvi) + 1e-9, 2) AS avg_uvi, round(avg(pop) + 1e-9, 3) AS avg_pop, round(avg(rain_1h) + 1e-9, 2) AS avg_rain_1h,
  max(rain_1h) AS max_rain_1h, max(pop) AS max_pop, count(*) FILTER (WHERE rain_1h > 0.5) AS rainy_ward_count,
  round(degrees(atan2(avg(sin(radians(wind_deg))), avg(cos(radians(wind_deg))))) + 360 + 1e-9, 1) % 360.0::DOUBLE AS avg_wind_deg,
  max(wind_gust) AS max_wind_gust, max(uvi) AS max_uvi, count(DISTINCT ward_id) AS ward_count, any_value(m.weather_main) AS weather_main
FROM placed p JOIN modes m USING ({key}, ts_utc) WHERE {where} GROUP BY {key}, ts_utc"""


def group_hours(spark, sf_dir, key: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The hourly roll-up by group or region; the bounds reach the scan, and instants are shown as text at the end."""
    return hourly_rollup(placed(spark, sf_dir, since, until), key).withColumn("ts_utc", shown("ts_utc"))


@query(_hourly_sql("district_id"))
def agg_district_hourly(spark, sf_dir):
    return group_hours(spark, sf_dir, "district_id")


@query(_hourly_sql("city_id"))
def agg_city_hourly(spark, sf_dir):
    return group_hours(spark, sf_dir, "city_id")


@query(_hourly_sql("city_id", "data_kind = 'forecast'"))
def agg_city_hourly_forecast(spark, sf_dir):
    return hourly_rollup(placed(spark, sf_dir, since=AS_OF).where("data_kind = 'forecast'"), "city_id").withColumn("ts_utc", shown("ts_utc"))


def daily(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Leaf days by civil date: extremes and means of readings, the last condition of the day."""
    keys = keys or ["ward_id"]
    return facts.withColumn("date", F.to_date(civil("ts_utc"))).groupBy(*keys, "date").agg(
        F.min("temp").alias("temp_min"), F.max("temp").alias("temp_max"), rounded(F.avg("temp"), 2).alias("temp_avg"),
        rounded(F.avg("humidity"), 0).cast("int").alias("humidity"), rounded(F.avg("pressure"), 0).cast("int").alias("pressure"), rounded(F.avg("wind_speed"), 2).alias("wind_speed"),
        F.max("pop").alias("pop"), rounded(F.sum(F.coalesce("rain_1h", F.lit(0.0))), 2).alias("rain_total"), F.max("uvi").alias("uvi"), F.max("wind_gust").alias("wind_gust"),
        F.max_by("weather_main", "ts_utc").alias("weather_main"), rounded(F.avg("dew_point"), 2).alias("dew_point"), rounded(F.avg("clouds"), 0).cast("int").alias("clouds"),
        F.max_by("wind_deg", "ts_utc").alias("wind_deg"),
    )


DAILY_SQL = HOURLY_SQL + f""", daily AS (
  SELECT ward_id, district_id, city_id, (ts_utc + INTERVAL {CIVIL_HOURS} HOUR)::DATE AS date, min(temp) AS temp_min, max(temp) AS temp_max, round(avg(temp) + 1e-9, 2) AS temp_avg,
    round(avg(humidity) + 1e-9)::INT AS humidity, round(avg(pressure) + 1e-9)::INT AS pressure, round(avg(wind_speed) + 1e-9, 2) AS wind_speed,
    max(pop) AS pop, round(sum(coalesce(rain_1h, 0)) + 1e-9, 2) AS rain_total, max(uvi) AS uvi, max(wind_gust) AS wind_gust, arg_max(weather_main, ts_utc) AS weather_main,
    round(avg(dew_point) + 1e-9, 2) AS dew_point, round(avg(clouds) + 1e-9)::INT AS clouds, arg_max(wind_deg, ts_utc) AS wind_deg
  FROM placed GROUP BY ALL)
"""


@query(DAILY_SQL.replace("FROM placed GROUP BY ALL", "FROM placed WHERE data_kind = 'history' GROUP BY ALL") + "SELECT * EXCLUDE (district_id, city_id) REPLACE (date::VARCHAR AS date) FROM daily")
def agg_history_to_daily(spark, sf_dir):
    return daily(hourly(spark, sf_dir).where("data_kind = 'history'")).withColumn("date", F.col("date").cast("string"))


DAILY = Shape(
    {
        "avg_temp": ("temp_avg", 2), "avg_humidity": ("humidity", 1), "avg_pop": ("pop", 2), "total_rain": ("rain_total", 2), "avg_dew_point": ("dew_point", 2), "avg_pressure": ("pressure", 1), "avg_clouds": ("clouds", 1),
        "avg_wind_speed": ("wind_speed", 2),
    },
    {"temp_min": "temp_min"}, {"temp_max": "temp_max", "max_pop": "pop", "max_rain_total": "rain_total", "max_wind_gust": "wind_gust", "max_uvi": "uvi"}, f"rain_total > {RAINY_DAY}",
)


def daily_rollup(days: DataFrame, key: str) -> DataFrame:
    return rolled(days, [key, "date"], DAILY)


def civil_bounds(first: str | None = None, last: str | None = None) -> tuple[str | None, str | None]:
    """The instants of UTC from which and before which the civil dates from `first` to `last` lie."""
    start = lambda day: str(datetime.fromisoformat(day) - timedelta(hours=CIVIL_HOURS))
    return first and start(first), last and start(str(datetime.fromisoformat(last) + timedelta(days=1)))


def group_days(spark, sf_dir, key: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The daily roll-up of the civil dates from `first` to `last`; the bounds reach the scan."""
    rows = daily_rollup(days_of(spark, sf_dir, *civil_bounds(first, last)), key)
    return rows.withColumn("date", F.col("date").cast("string"))


def days_of(spark, sf_dir, since: str | None = None, until: str | None = None) -> DataFrame:
    return daily(placed(spark, sf_dir, since, until), ["ward_id", "district_id", "city_id"])


def _daily_sql(key: str) -> str:
    return DAILY_SQL + f""", modes AS (
  SELECT {key}, date, weather_main FROM daily GROUP BY {key}, date, weather_main QUALIFY row_number() OVER (PARTITION BY {key}, date ORDER BY count(*) DESC, weather_main) = 1)
SELECT {key}, date::VARCHAR AS date, round(avg(temp_avg) + 1e-9, 2) AS avg_temp, min(temp_min) AS temp_min, max(temp_max) AS temp_max, round(avg(humidity) + 1e-9, 1) AS avg_humidity,
  round(avg(pop) + 1e-9, 2) AS avg_pop, max(pop) AS max_pop, round(avg(rain_total) + 1e-9, 2) AS total_rain, max(rain_total) AS max_rain_total,
  round(avg(dew_point) + 1e-9, 2) AS avg_dew_point, round(avg(pressure) + 1e-9, 1) AS avg_pressure, round(avg(clouds) + 1e-9, 1) AS avg_clouds,
  count(*) FILTER (WHERE rain_total > 1.0) AS rainy_ward_count, round(avg(wind_speed) + 1e-9, 2) AS avg_wind_speed,
  round(degrees(atan2(avg(sin(radians(wind_deg))), avg(cos(radians(wind_deg))))) + 360 + 1e-9, 1) % 360.0::DOUBLE AS avg_wind_deg,
  max(wind_gust) AS max_wind_gust, max(uvi) AS max_uvi, count(DISTINCT ward_id) AS ward_count, any_value(m.weather_main) AS weather_main
FROM daily d JOIN modes m USING ({key}, date) GROUP BY {key}, date"""


@query(_daily_sql("district_id"))
def agg_district_daily(spark, sf_dir):
    return group_days(spark, sf_dir, "district_id")


@query(_daily_sql("city_id"))
def agg_city_daily(spark, sf_dir):
    return group_days(spark, sf_dir, "city_id")


@query(HOURLY_SQL + """SELECT data_kind, strftime(max(ts_utc), '%Y-%m-%d %H:%M:%S') AS latest, floor(date_diff('second', max(ts_utc), TIMESTAMP '2024-01-20 06:00:00') / 60)::BIGINT AS age_minutes, count(*) AS n_rows
FROM hourly GROUP BY data_kind""")
def agg_latest_per_kind(spark, sf_dir):
    age = F.floor((F.unix_timestamp(F.lit("2024-01-20 06:00:00").cast("timestamp")) - F.unix_timestamp(F.max("ts_utc"))) / 60)
    return hourly(spark, sf_dir).groupBy("data_kind").agg(shown(F.max("ts_utc")).alias("latest"), age.cast("long").alias("age_minutes"), F.count(F.lit(1)).alias("n_rows"))


#: Parts of the civil day: name, first hour, hour after the last.
DAYPARTS = (("sáng", 6, 10), ("trưa", 10, 14), ("chiều", 14, 18), ("tối", 18, 22))


@query(HOURLY_SQL + """SELECT city_id, (ts_utc + INTERVAL 7 HOUR)::DATE::VARCHAR AS date,
  CASE WHEN h >= 6 AND h < 10 THEN 'sáng' WHEN h >= 10 AND h < 14 THEN 'trưa' WHEN h >= 14 AND h < 18 THEN 'chiều' ELSE 'tối' END AS part,
  round(avg(temp) + 1e-9, 1) AS avg_temp, min(temp) AS min_temp, max(temp) AS max_temp, round(avg(humidity) + 1e-9, 0) AS avg_humidity, max(uvi) AS max_uvi, max(pop) AS max_pop, round(avg(wind_speed) + 1e-9, 1) AS avg_wind
FROM (SELECT *, hour(ts_utc + INTERVAL 7 HOUR) AS h FROM placed) WHERE h >= 6 AND h < 22 GROUP BY ALL""")
def agg_daypart(spark, sf_dir):
    h, part = F.hour(civil("ts_utc")), F.lit(None).cast("string")
    for name, a, b in DAYPARTS:
        part = F.when((h >= a) & (h < b), name).otherwise(part)
    rows = placed(spark, sf_dir).withColumn("part", part).where("part IS NOT NULL").withColumn("date", F.to_date(civil("ts_utc")).cast("string"))
    return rows.groupBy("city_id", "date", "part").agg(
        rounded(F.avg("temp"), 1).alias("avg_temp"), F.min("temp").alias("min_temp"), F.max("temp").alias("max_temp"), rounded(F.avg("humidity"), 0).alias("avg_humidity"),
        F.max("uvi").alias("max_uvi"), F.max("pop").alias("max_pop"), rounded(F.avg("wind_speed"), 1).alias("avg_wind"),
    )


@query(_daily_sql("city_id").replace("\nSELECT city_id, date::VARCHAR", "\n, days AS (SELECT city_id, date::VARCHAR", 1) + """)
SELECT city_id, arg_min(date, (-temp_max, date)) AS hottest, arg_min(date, (temp_min, date)) AS coolest, arg_min(date, (-total_rain, date)) AS rainiest, arg_min(date, (total_rain, avg_pop, date)) AS driest,
  round(avg(avg_temp) + 1e-9, 1) AS mean_temp, round(sum(total_rain) + 1e-9, 1) AS sum_rain, count(*) FILTER (WHERE total_rain > 0.5) AS rain_days
FROM days WHERE date BETWEEN '2024-01-07' AND '2024-01-20' GROUP BY city_id""")
def agg_superlatives(spark, sf_dir):
    """Hottest, coolest, rainiest and driest day, with the period's means, of 14 days up to the reference day."""
    days = group_days(spark, sf_dir, "city_id", "2024-01-07", "2024-01-20")
    by = lambda *keys: F.min_by("date", F.struct(*keys, "date"))
    return days.groupBy("city_id").agg(
        by((-F.col("temp_max")).alias("k")).alias("hottest"), by("temp_min").alias("coolest"), by((-F.col("total_rain")).alias("k")).alias("rainiest"), by("total_rain", "avg_pop").alias("driest"),
        rounded(F.avg("avg_temp"), 1).alias("mean_temp"), rounded(F.sum("total_rain"), 1).alias("sum_rain"), F.count_if(F.col("total_rain") > 0.5).alias("rain_days"),
    )


@query(_hourly_sql("district_id").replace("\nSELECT district_id, strftime", "\n, r AS (SELECT district_id, strftime", 1) + """)
SELECT district_id, ts_utc, rainy_ward_count, ward_count, CASE WHEN rainy_ward_count = 0 THEN 'none' WHEN rainy_ward_count / ward_count <= 0.3 THEN 'local' WHEN rainy_ward_count / ward_count < 0.7 THEN 'uneven' ELSE 'widespread' END AS extent,
  CASE WHEN max_pop > avg_pop + 0.15 THEN max_pop END AS notable_pop FROM r""")
def agg_rain_extent(spark, sf_dir):
    ratio = F.col("rainy_ward_count") / F.col("ward_count")
    extent = F.when(F.col("rainy_ward_count") == 0, "none").when(ratio <= 0.3, "local").when(ratio < 0.7, "uneven").otherwise("widespread")
    return agg_district_hourly(spark, sf_dir).select("district_id", "ts_utc", "rainy_ward_count", "ward_count", extent.alias("extent"), F.when(F.col("max_pop") > F.col("avg_pop") + 0.15, F.col("max_pop")).alias("notable_pop"))


@query(HOURLY_SQL + "SELECT city_id, data_kind, weather_main, count(*) AS n_rows, grouping(city_id, data_kind, weather_main)::BIGINT AS level FROM placed GROUP BY GROUPING SETS ((city_id, data_kind), (city_id, weather_main), (city_id), ())")
def agg_grouping_sets(spark, sf_dir):
    return spark.sql("SELECT city_id, data_kind, weather_main, count(*) AS n_rows, grouping_id(city_id, data_kind, weather_main) AS level FROM {placed} GROUP BY GROUPING SETS ((city_id, data_kind), (city_id, weather_main), (city_id), ())", placed=placed(spark, sf_dir))


@query(HOURLY_SQL + "SELECT city_id, round(avg(humidity) + 1e-9, 1) AS avg_humidity, min(humidity) AS min_humidity, max(humidity) AS max_humidity, round(avg(dew_point) + 1e-9, 1) AS avg_dew_point FROM placed WHERE data_kind = 'forecast' GROUP BY city_id")
def agg_humidity_stats(spark, sf_dir):
    return placed(spark, sf_dir, since=AS_OF).where("data_kind = 'forecast'").groupBy("city_id").agg(rounded(F.avg("humidity"), 1).alias("avg_humidity"), F.min("humidity").alias("min_humidity"), F.max("humidity").alias("max_humidity"), rounded(F.avg("dew_point"), 1).alias("avg_dew_point"))


@query(HOURLY_SQL + """SELECT ward_id, round(avg(temp) + 1e-9, 1) AS temp, round(avg(humidity) + 1e-9, 0) AS humidity, max(pop) AS pop, max(rain_1h) AS rain_1h, max(uvi) AS uvi, max(wind_speed) AS wind_speed, arg_min(weather_main, ts_utc) AS weather_main
FROM hourly WHERE ts_utc > TIMESTAMP '2024-01-20 06:00:00' AND ts_utc <= TIMESTAMP '2024-01-21 06:00:00' GROUP BY ward_id""")
def agg_forecast_repr(spark, sf_dir):
    rows = hourly(spark, sf_dir, NEXT_HOUR, NEXT_DAY[:11] + "07:00:00")
    return rows.groupBy("ward_id").agg(rounded(F.avg("temp"), 1).alias("temp"), rounded(F.avg("humidity"), 0).alias("humidity"), F.max("pop").alias("pop"), F.max("rain_1h").alias("rain_1h"), F.max("uvi").alias("uvi"), F.max("wind_speed").alias("wind_speed"), F.min_by("weather_main", "ts_utc").alias("weather_main"))
