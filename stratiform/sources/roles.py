"""Role adapters: the driver's tables as an observation hierarchy (leaf, group, region) with hourly and daily facts.

Leaves are customers, groups nations, regions regions. An hourly observation is an event; of several in an hour the
latest counts. All derived readings are integer arithmetic on the event's id, so that any engine gets the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that stands for "now" in every query.
AS_OF = "2024-01-20 06:00:00"
#: The hours before and after it, as bounds of scans.
NEXT_HOUR, TWO_HOURS_AGO, NEXT_DAY = "2024-01-20 07:00:00", "2024-01-20 04:00:00", "2024-01-21 06:00:00"
#: Hours from UTC to civil time (no daylight saving).
CIVIL_HOURS = 7
#: Event types as conditions.
CONDITIONS = {"click": "Clouds", "view": "Clear", "purchase": "Rain", "signup": "Drizzle", "error": "Thunderstorm"}
WET = ("Rain", "Drizzle", "Thunderstorm")
READINGS = ("temp", "humidity", "dew_point", "pressure", "clouds", "wind_deg", "wind_speed", "wind_gust", "visibility", "pop", "uvi", "rain_1h", "weather_main", "data_kind")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def civil(ts: Column | str) -> Column:
    """Civil time of a UTC instant."""
    return (F.col(ts) if isinstance(ts, str) else ts) + F.expr(f"INTERVAL {CIVIL_HOURS} HOURS")


def shown(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero for readings; the nudge makes decimal ties that doubles miss come out alike everywhere."""
    return F.round(value + F.lit(1e-9), digits)


def observations(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row for each event, with readings; (ward_id, ts_utc) is not unique yet.

    `since` and `until`, both on the hour, bound the scan itself: the filter is on the stored column, so it reaches
    the Parquet statistics, which a filter on the hour computed from it does not. `until` is not included.
    """
    e = table(spark, sf_dir, "events")
    stored = e.schema["ts"].dataType
    e = e.where(F.col("ts") >= F.lit(since).cast(stored)) if since else e
    e = e.where(F.col("ts") < F.lit(until).cast(stored)) if until else e
    n = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    main = F.lit(None).cast("string")
    for kind, condition in CONDITIONS.items():
        main = F.when(F.col("event_type") == kind, condition).otherwise(main)
    kind = F.when(ts < as_of() - F.expr("INTERVAL 24 HOURS"), "history").when(ts <= as_of(), "current").otherwise("forecast")
    first = e.select(
        F.col("user_id").alias("ward_id"), F.date_trunc("hour", ts).alias("ts_utc"), ts.alias("arrived"), n.alias("event_id"), main.alias("weather_main"), kind.alias("data_kind"),
        (F.col("value") / 10).alias("temp"), F.get_json_object("props", "$.k").cast("int").alias("humidity"),
        ((n * 37) % 360).cast("int").alias("wind_deg"), ((n * 13) % 101).cast("int").alias("clouds"), (985 + (n * 7) % 50).cast("int").alias("pressure"),
        ((n * 11) % 101 / F.lit(100.0)).alias("pop"), ((n * 3) % 13).cast("double").alias("uvi"), ((n * 17) % 150 / F.lit(10.0)).alias("wind_speed"),
        (((n * 17) % 150 + (n * 3) % 80) / F.lit(10.0)).alias("wind_gust"), (100 + (n * 101) % 9900).cast("int").alias("visibility"),
    )
    return first.withColumns(
        {
            "rain_1h": F.when(F.col("weather_main").isin(*WET), (n * 19) % 60 / F.lit(10.0)).otherwise(F.lit(0.0)),
            "dew_point": F.col("temp") - (100 - F.col("humidity")) / F.lit(5.0),
        }
    )


def latest_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order`: a partial aggregate, so no key is gathered or sorted."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*rest).alias("row"))).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in order], *[F.col(f"best.row.{c}").alias(c) for c in rest])


def hourly(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row for each (ward_id, ts_utc), from `since` up to before `until`: the latest observation."""
    return latest_of(observations(spark, sf_dir, since, until), ["ward_id", "ts_utc"], ["arrived", "event_id"])


def wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ward_id"), F.col("c_name").alias("ward_name"), F.col("c_nationkey").alias("district_id"))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("district_name"), F.col("n_regionkey").alias("city_id"))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("city_id"), F.col("r_name").alias("city_name"))


def placed(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Hourly facts with their group and region. Groups number a few dozen; leaves may be many, so that join is left
    to the optimizer, which broadcasts them only below its size limit."""
    facts = hourly(spark, sf_dir, since, until) if facts is None else facts
    return facts.join(wards(spark, sf_dir).drop("ward_name"), "ward_id").join(F.broadcast(districts(spark, sf_dir).drop("district_name")), "district_id")


#: The same adapters as SQL, the beginning of every oracle query.
HOURLY_SQL = f"""WITH observations AS (
  SELECT *, temp - (100 - humidity) / 5.0::DOUBLE AS dew_point,
         CASE WHEN weather_main IN ('Rain', 'Drizzle', 'Thunderstorm') THEN ((event_id * 19) % 60) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS rain_1h
  FROM (SELECT user_id AS ward_id, date_trunc('hour', ts) AS ts_utc, ts AS arrived, event_id, value / 10 AS temp,
    json_extract(props, '$.k')::INT AS humidity,
    CASE event_type WHEN 'click' THEN 'Clouds' WHEN 'view' THEN 'Clear' WHEN 'purchase' THEN 'Rain' WHEN 'signup' THEN 'Drizzle' WHEN 'error' THEN 'Thunderstorm' END AS weather_main,
    CASE WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 'history' WHEN ts <= TIMESTAMP '{AS_OF}' THEN 'current' ELSE 'forecast' END AS data_kind,
    ((event_id * 37) % 360)::INT AS wind_deg, ((event_id * 13) % 101)::INT AS clouds, (985 + (event_id * 7) % 50)::INT AS pressure,
    ((event_id * 11) % 101) / 100.0::DOUBLE AS pop, ((event_id * 3) % 13)::DOUBLE AS uvi, ((event_id * 17) % 150) / 10.0::DOUBLE AS wind_speed,
    ((event_id * 17) % 150 + (event_id * 3) % 80) / 10.0::DOUBLE AS wind_gust, (100 + (event_id * 101) % 9900)::INT AS visibility
    FROM events)),
hourly AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY ward_id, ts_utc ORDER BY arrived DESC, event_id DESC) = 1),
placed AS (SELECT h.*, c_nationkey AS district_id, n_regionkey AS city_id FROM hourly h JOIN customer ON c_custkey = ward_id JOIN nation ON n_nationkey = c_nationkey)
"""
