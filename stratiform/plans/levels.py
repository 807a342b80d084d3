"""The series of leaves, groups and regions under common names, so that one tool serves every place at every level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.operators import materialise
from stratiform.operators.rollup import DAILY, DAILY_SQL, HOURLY, Shape, _daily_sql, _hourly_sql, days_of
from stratiform.sources.roles import AS_OF, HOURLY_SQL, NEXT_HOUR, latest_of, observations, placed, shown, table

LEVELS = ("ward", "district", "city")
#: A place: its level and its id there.
PLACE = ["level", "place_id"]
_KEYS = {"ward": "ward_id", "district": "district_id", "city": "city_id"}
_ROLLED = ("district", "city")
#: Readings by their name in the roll-ups, and the leaf's reading that they stand for.
HOURS = {
    "avg_temp": "temp", "avg_humidity": "humidity", "avg_dew_point": "dew_point", "avg_pressure": "pressure", "avg_clouds": "clouds", "avg_wind_speed": "wind_speed", "avg_wind_deg": "wind_deg",
    "avg_visibility": "visibility", "avg_pop": "pop", "avg_rain_1h": "rain_1h", "max_wind_gust": "wind_gust", "max_uvi": "uvi",
}
DAYS = {"avg_temp": "temp_avg", "temp_min": "temp_min", "temp_max": "temp_max", "avg_humidity": "humidity", "avg_pop": "pop", "total_rain": "rain_total", "avg_wind_speed": "wind_speed", "avg_dew_point": "dew_point", "max_uvi": "uvi"}


def known(levels) -> None:
    if unknown := set(levels) - set(LEVELS):
        raise ValueError(f"levels are {', '.join(LEVELS)}, not {', '.join(sorted(unknown))}")


def _asked(rows: DataFrame, levels, place: int | None) -> DataFrame:
    """A row for each level that is asked for; the place, if one is given, is chosen before the rows are multiplied."""
    known(levels)
    ids = {level: F.col(_KEYS[level]).cast("long") for level in LEVELS if level in levels}
    if place is not None:
        rows = rows.where(reduce(Column.__or__, (own == place for own in ids.values())))
    each = rows.withColumn("p", F.explode(F.array(*[F.struct(F.lit(level).alias("level"), own.alias("place_id")) for level, own in ids.items()])))
    each = each.select("*", "p.level", "p.place_id").drop("p")
    return each if place is None else each.where(F.col("place_id") == place)


def _rolled(rows: DataFrame, shape: Shape, columns: dict[str, str], time: str) -> DataFrame:
    """All levels from one pass: a leaf has one row for each time, which it keeps as it is."""
    states = rows.groupBy(*PLACE, time, "weather_main").agg(*shape.state(), *[F.max(c).alias(f"own_{name}") for name, c in columns.items()])
    both = states.groupBy(*PLACE, time).agg(*shape.result(), *[F.max(f"own_{name}").alias(f"own_{name}") for name in columns])
    leaf = F.col("level") == "ward"
    return both.select(*PLACE, time, *[F.when(leaf, F.col(f"own_{name}").cast("double")).otherwise(F.col(name).cast("double")).alias(name) for name in columns], "weather_main")


def series(spark, sf_dir, levels=LEVELS, place: int | None = None, since: str | None = None, until: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Hours of all places, or of the one given at each level, from one scan that the bounds reach; or from `facts`, if given."""
    facts = placed(spark, sf_dir, since, until) if facts is None else facts
    return _rolled(_asked(facts, levels, place), HOURLY, HOURS, "ts_utc").withColumn("ts_utc", shown("ts_utc"))


def last_facts(spark, sf_dir, levels=LEVELS, place: int | None = None, until: str = NEXT_HOUR) -> DataFrame:
    """The facts of the last hour before `until` of each leaf, group and region that is asked for.

    The hours are found from two columns of all rows before `until`, by partial maxima; the facts themselves are read from the earliest
    of these hours on, and only rows of such hours go on to the aggregates. A place that has been silent for long moves the bound
    back to its own last hour.
    """
    times = table(spark, sf_dir, "events").select(F.col("user_id").alias("ward_id"), F.col("ts").cast("timestamp").alias("ts")).where(F.col("ts") < F.lit(until).cast("timestamp"))
    leaves = placed(spark, sf_dir, facts=times.groupBy("ward_id").agg(F.date_trunc("hour", F.max("ts")).alias("last")))
    known(levels)
    each = leaves
    for level in levels:
        if level == "ward":
            leaves = leaves.withColumn("last_ward", F.col("last"))
        else:  # groups and regions number a few dozen
            leaves = leaves.join(F.broadcast(each.groupBy(_KEYS[level]).agg(F.max("last").alias(f"last_{level}"))), _KEYS[level])
    if place is not None:
        leaves = leaves.where(reduce(Column.__or__, (F.col(_KEYS[level]) == place for level in levels)))
    wanted = leaves.select(F.col("ward_id").alias("of"), F.explode(F.array_distinct(F.array(*[f"last_{level}" for level in levels]))).alias("hour"))
    since = wanted.agg(F.min("hour").cast("string")).first()[0]  # one row
    rows = observations(spark, sf_dir, since or until, until).join(wanted, (F.col("ward_id") == F.col("of")) & (F.col("ts_utc") == F.col("hour")), "left_semi")
    return placed(spark, sf_dir, facts=latest_of(rows, ["ward_id", "ts_utc"], ["arrived", "event_id"]))


def days(spark, sf_dir, levels=LEVELS, place: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Civil days of all places, from one scan."""
    return _rolled(_asked(days_of(spark, sf_dir, since, until), levels, place), DAILY, DAYS, "date").withColumn("date", F.col("date").cast("string"))


def stored_series(spark, out: str, level: str, place: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Hours of groups or regions as `materialise.run_aggregation` stored them, dates pruned, in the form of `series`."""
    rows = materialise.stored(spark, out, f"{level}_hourly", since and since[:10])
    rows = rows.where(F.col("ts_utc") >= F.lit(since).cast("timestamp")) if since else rows
    rows = rows.where(F.col("ts_utc") < F.lit(until).cast("timestamp")) if until else rows
    rows = rows if place is None else rows.where(F.col(_KEYS[level]) == place)
    return rows.select(F.lit(level).alias("level"), F.col(_KEYS[level]).cast("long").alias("place_id"), shown("ts_utc").alias("ts_utc"), *[F.col(c).cast("double").alias(c) for c in HOURS], "weather_main")


def stored_days(spark, out: str, level: str, place: int | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Civil days as stored; the bounds are dates, the latter not included."""
    rows = materialise.stored(spark, out, f"{level}_daily", since, until)
    rows = rows if place is None else rows.where(F.col(_KEYS[level]) == place)
    return rows.select(F.lit(level).alias("level"), F.col(_KEYS[level]).cast("long").alias("place_id"), F.col("date").cast("string").alias("date"), *[F.col(c).cast("double").alias(c) for c in DAYS], "weather_main")


def forecast(spark, sf_dir, hours: int, levels=LEVELS, place: int | None = None) -> DataFrame:
    """The first `hours` (1 to 48) rows of each place after the reference instant; `nth` counts from 1."""
    nth = F.row_number().over(Window.partitionBy(*PLACE).orderBy("ts_utc"))
    return series(spark, sf_dir, levels, place, since=NEXT_HOUR).withColumn("nth", nth).where(F.col("nth") <= max(1, min(hours, 48)))


def raw(rows: DataFrame) -> DataFrame:
    """Roll-up names as readings' names, for the rules of single observations."""
    return rows.withColumnsRenamed(HOURS)


# ---------------------------------------------------------------- the same as SQL


def _rolled_sql(make, level: str) -> str:
    key = _KEYS[level]
    modes, _, select = make(key).removeprefix(HOURLY_SQL).partition("\nSELECT ")
    return modes.replace("modes", f"{level}_modes") + f", {level}_rolled AS (SELECT " + select.replace("JOIN modes", f"JOIN {level}_modes") + ")\n"


def _union_sql(source: str, columns: dict[str, str], time: str, leaf_time: str) -> str:
    leaf = ", ".join(f"{c}::DOUBLE AS {name}" for name, c in columns.items())
    parts = [f"SELECT 'ward' AS level, ward_id::BIGINT AS place_id, {leaf_time} AS {time}, {leaf}, weather_main FROM {source}"]
    parts += [f"SELECT '{level}', {key}::BIGINT, {time}, " + ", ".join(f"{name}::DOUBLE" for name in columns) + f", weather_main FROM {level}_rolled" for level, key in _KEYS.items() if level in _ROLLED]
    return " UNION ALL ".join(parts)


def _day_parts(level: str) -> str:
    return _rolled_sql(lambda key: HOURLY_SQL + _daily_sql(key).removeprefix(DAILY_SQL), level)


def _days_sql() -> str:
    return DAILY_SQL + "".join(map(_day_parts, _ROLLED)) + ", days AS (" + _union_sql("daily", DAYS, "date", "date::VARCHAR") + ")\n"


SERIES_ALL = HOURLY_SQL + "".join(_rolled_sql(_hourly_sql, level) for level in _ROLLED) + ", series AS (" + _union_sql("hourly", HOURS, "ts_utc", "strftime(ts_utc, '%Y-%m-%d %H:%M:%S')") + ")\n"
DAYS_ALL = _days_sql()
RAW_SQL = ", ".join(f"{name} AS {c}" for name, c in HOURS.items())


def forecast_sql(hours: int) -> str:
    return SERIES_ALL + f", f AS (SELECT *, row_number() OVER (PARTITION BY level, place_id ORDER BY ts_utc)::INT AS nth FROM series WHERE ts_utc > '{AS_OF}' QUALIFY nth <= {hours})\n"
