"""Stored roll-ups: mergeable states by day, and the tables of groups and regions that are made of them.

A run reads the facts of whole UTC days once and stores two grains of states in one pass: of groups by hour and condition,
and of leaves by the part of a civil day that lies in a UTC day. Hourly tables and all tables of regions are merged from
these, as are daily ones, for which the parts of a civil day meet across the midnight of UTC. A run with bounds thus
replaces whole partitions by what a run over everything would write: days of UTC that the bounds touch in states and hourly
tables, and in daily tables the civil days that these have hours of.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stratiform.operators.rollup import DAILY, HOURLY, rolled
from stratiform.registry import query
from stratiform.sources.roles import CIVIL_HOURS, HOURLY_SQL, civil, latest_of, placed, rounded

HOURLY_KINDS, DAILY_KINDS = ("current", "forecast", "history"), ("forecast", "history")
KEYS = {"district": "district_id", "city": "city_id"}
_ONE = timedelta(days=1)


def states(facts: DataFrame) -> DataFrame:
    """States of the facts (leaf hours with group and region) at both grains, from one pass."""
    rows = facts.withColumn("day", F.to_date("ts_utc")).withColumn("date", F.to_date(civil("ts_utc")))
    both = ["day", "data_kind", "district_id", "city_id"]
    hour, leaf = [*both, "ts_utc", "weather_main"], [*both, "ward_id", "date"]
    last = F.max(F.struct("ts_utc", "weather_main", "wind_deg")).alias("last")
    found = rows.groupingSets([[F.col(c) for c in keys] for keys in (hour, leaf)], *both, "ts_utc", "weather_main", "ward_id", "date")
    return found.agg(F.when(F.grouping("ward_id") == 1, "hour").otherwise("leaf_day").alias("grain"), *HOURLY.state(), last)


def leaf_days(found: DataFrame) -> DataFrame:
    """Civil days of leaves, as `rollup.daily` makes them of facts, from states of their parts."""
    mean = lambda c, digits: rounded(F.sum(f"sum_{c}") / F.sum(f"count_{c}"), digits)
    whole = lambda c: mean(c, 0).cast("int")
    merged = found.groupBy("data_kind", "ward_id", "district_id", "city_id", "date").agg(
        F.min("min_temp").alias("temp_min"), F.max("max_temp").alias("temp_max"), mean("temp", 2).alias("temp_avg"), whole("humidity").alias("humidity"), whole("pressure").alias("pressure"),
        mean("wind_speed", 2).alias("wind_speed"), F.max("max_pop").alias("pop"), rounded(F.coalesce(F.sum("sum_rain_1h"), F.lit(0.0)), 2).alias("rain_total"), F.max("max_uvi").alias("uvi"),
        F.max("max_wind_gust").alias("wind_gust"), mean("dew_point", 2).alias("dew_point"), whole("clouds").alias("clouds"), F.max("last").alias("last"),
    )
    return merged.withColumns({"weather_main": F.col("last.weather_main"), "wind_deg": F.col("last.wind_deg")}).drop("last")


def hours_of(found: DataFrame, key: str) -> DataFrame:
    """Hourly roll-up by kind and group or region, from states of groups."""
    keys = ["data_kind", key, "ts_utc"]
    return found.groupBy(*keys, "weather_main").agg(*HOURLY.merge()).groupBy(*keys).agg(*HOURLY.result())


def days_of(found: DataFrame, key: str) -> DataFrame:
    return rolled(leaf_days(found), ["data_kind", key, "date"], DAILY)


def _within(column: str, lo: date | None, hi: date | None) -> Column:
    """Whether a date lies in [lo, hi)."""
    own = F.lit(True)
    own = own & (F.col(column) >= F.lit(lo)) if lo else own
    return own & (F.col(column) < F.lit(hi)) if hi else own


def _replace(rows: DataFrame, path: str, keys: list[str], kinds: tuple[str, ...], every: tuple[str, ...]) -> dict[str, int]:
    """Writes `rows` over the dates that they have; a kind that stands later in `kinds` wins. Gives the rows of each kind.

    Stored rows of kinds that are not listed stay where no new row has their key; the result is then written beside the
    table first, so that a failure leaves either the old dates or the new ones.
    """
    spark = rows.sparkSession
    turn = F.array_position(F.array(*map(F.lit, kinds)), F.col("data_kind"))
    last = latest_of(rows.where(F.col("data_kind").isin(*kinds)).withColumn("turn", turn), keys, ["turn"]).drop("turn")
    seen = Observation()
    last = last.observe(seen, *[F.count_if(F.col("data_kind") == kind).alias(kind) for kind in kinds]).withColumn("day", F.to_date(keys[-1]))
    table, staged = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-staged"))
    files = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = not set(every) <= set(kinds) and files.exists(table)
    if beside:
        last.write.mode("overwrite").parquet(f"{path}-staged")
        new = spark.read.parquet(f"{path}-staged")
        others = spark.read.parquet(path).where(~F.col("data_kind").isin(*kinds)).join(new.select("day").distinct(), "day", "left_semi").join(new, keys, "left_anti")
        new.unionByName(others).write.mode("overwrite").parquet(f"{path}-merged")
        last = spark.read.parquet(f"{path}-merged")
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    if beside:
        files.delete(staged, True)
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}-merged"), True)
    return {kind: seen.get[kind] for kind in kinds}


def run_aggregation(spark, sf_dir, out: str, hourly_kinds=HOURLY_KINDS, daily_kinds=DAILY_KINDS, since: str | None = None, until: str | None = None) -> dict[str, int]:
    """Brings the tables under `out` up to date for facts from `since` to before `until`, and gives the rows written by task
    (table and kind, as `district_hourly_history`).

    Bounds may be any instants; the run covers every day that they touch, wholly, so it can be repeated and its parts can be
    run in any order. Within a table and key a kind that stands later in the list replaces earlier ones, and listed kinds
    replace stored ones that are not listed. An empty list leaves those tables alone.
    """
    lo = datetime.fromisoformat(since).date() if since else None
    hi = datetime.fromisoformat(until) if until else None
    hi = hi and hi.date() + (_ONE if hi.time() else timedelta())
    facts = placed(spark, sf_dir, lo and f"{lo} 00:00:00", hi and f"{hi} 00:00:00")
    states(facts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grain", "day").parquet(f"{out}/states")
    kept, written = spark.read.parquet(f"{out}/states"), {}
    hourly = kept.where("grain = 'hour'").where(_within("day", lo, hi))
    # A day of UTC has hours of its own civil day and of the next one, and these have hours in the days beside it.
    parts = kept.where("grain = 'leaf_day'").where(_within("day", lo and lo - _ONE, hi and hi + _ONE)).where(_within("date", lo, hi and hi + _ONE))
    for level, key in KEYS.items():
        for grain, kinds, rows, time in (("hourly", hourly_kinds, hourly, "ts_utc"), ("daily", daily_kinds, parts, "date")):
            if kinds:
                made = hours_of(rows, key) if grain == "hourly" else days_of(rows, key)
                counts = _replace(made, f"{out}/{level}_{grain}", [key, time], tuple(kinds), HOURLY_KINDS if grain == "hourly" else DAILY_KINDS)
                written |= {f"{level}_{grain}_{kind}": n for kind, n in counts.items()}
    return written


def stored(spark, out: str, name: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """A stored table; `since` and `until` are dates that prune its partitions, the latter not included."""
    bounds = [x and date.fromisoformat(x) for x in (since, until)]
    return spark.read.parquet(f"{out}/{name}").where(_within("day", *bounds)).drop("day")


_CIVIL = f"(ts_utc + INTERVAL {CIVIL_HOURS} HOUR)::DATE"


@query(HOURLY_SQL + " UNION ALL ".join(
    [f"SELECT '{level}_hourly_{kind}' AS task, count(*) AS records FROM (SELECT DISTINCT {key}, ts_utc FROM placed WHERE data_kind = '{kind}')" for level, key in (("district", "district_id"), ("city", "city_id")) for kind in ("current", "forecast", "history")]
    + [f"SELECT '{level}_daily_{kind}', count(*) FROM (SELECT DISTINCT {key}, {_CIVIL} FROM placed WHERE data_kind = '{kind}')" for level, key in (("district", "district_id"), ("city", "city_id")) for kind in ("forecast", "history")]
))
def orch_run_aggregation(spark, sf_dir):
    """The rows that each task of a whole run gives, kinds apart, from one pass over the facts."""
    rows = placed(spark, sf_dir).withColumn("date", F.to_date(civil("ts_utc")))
    sets = {f"{level}_{grain}": [key, time] for level, key in KEYS.items() for grain, time in (("hourly", "ts_utc"), ("daily", "date"))}
    found = rows.groupingSets([[F.col("data_kind"), *map(F.col, keys)] for keys in sets.values()], "data_kind", *KEYS.values(), "ts_utc", "date").agg(F.grouping("city_id").alias("of_group"), F.grouping("date").alias("of_hour"))
    table = F.concat(F.when(F.col("of_group") == 1, "district").otherwise("city"), F.when(F.col("of_hour") == 1, "_hourly").otherwise("_daily"))
    counts = found.groupBy(table.alias("table"), "data_kind").agg(F.count(F.lit(1)).alias("records"))
    asked = reduce(Column.__or__, (F.col("table").endswith(grain) & F.col("data_kind").isin(*kinds) for grain, kinds in (("hourly", HOURLY_KINDS), ("daily", DAILY_KINDS))))
    return counts.where(asked).select(F.concat_ws("_", "table", "data_kind").alias("task"), "records")
