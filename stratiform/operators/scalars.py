"""Further row functions, simple aggregates and look-ups, each as a query with its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from stratiform.functions import bands, text
from stratiform.operators.advice import _band, _rowwise
from stratiform.operators.rollup import DAILY_SQL, _daily_sql, circular_mean, days_of, group_days, mode_of
from stratiform.operators.runs import FORECAST_SQL, forecast_series
from stratiform.operators.snapshot import _LATEST_CTE, latest_groups
from stratiform.registry import query
from stratiform.sources.roles import AS_OF, HOURLY_SQL, NEXT_HOUR, cities, civil, districts, hourly, placed, rounded, shown, table, wards

# Conditions and their names.
CONDITION_NAMES = {"Clear": "Trời quang", "Clouds": "Có mây", "Rain": "Mưa", "Drizzle": "Mưa phùn", "Thunderstorm": "Dông", "Mist": "Sương mù nhẹ", "Fog": "Sương mù", "Haze": "Mù khô"}
_NAMES_SQL = "CASE weather_main " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONDITION_NAMES.items()) + " ELSE weather_main END"


def condition_name():
    names = F.create_map(*[F.lit(x) for pair in CONDITION_NAMES.items() for x in pair])
    return F.coalesce(names[F.col("weather_main")], "weather_main")


def _feels():
    gap = F.col("dew_point") - F.col("temp")
    return F.when(gap > 3, "Nóng hơn thực tế").when(gap < -3, "Lạnh hơn thực tế").otherwise("Như thực tế")


_rowwise("str_weather_vi", "Name of the condition.", {"name": (condition_name, _NAMES_SQL)})
_rowwise("fn_feels_like", "Felt against measured temperature; the dew point stands for the felt one.", {"feels": (_feels, "CASE WHEN dew_point - temp > 3 THEN 'Nóng hơn thực tế' WHEN dew_point - temp < -3 THEN 'Lạnh hơn thực tế' ELSE 'Như thực tế' END")})
_rowwise("fn_uv_status_agg", "UV band of groups.", {"uv": _band("uvi", bands.UV_DAILY)})
_rowwise("fn_humidity_comfort", "Comfort by dew point.", {"comfort": _band("dew_point", bands.DEW_GROUP, True)})
_rowwise("fn_wind_dir_enrich", "Direction if there is one.", {"direction": (lambda: F.when(F.col("wind_deg").isNotNull(), bands.octant(F.col("wind_deg"))), "CASE WHEN wind_deg IS NULL THEN NULL ELSE ['Bắc', 'Đông Bắc', 'Đông', 'Đông Nam', 'Nam', 'Tây Nam', 'Tây', 'Tây Bắc'][(round_even((wind_deg % 360) / 45, 0)::INT % 8) + 1] END")})
_rowwise("prj_alias_norm", "Readings under their canonical names, the first that is there.", {"rain_total": (lambda: F.coalesce("rain_1h", F.lit(0.0)), "coalesce(rain_1h, 0.0)"), "uvi_max": (lambda: F.col("uvi"), "uvi"), "wind": (lambda: F.coalesce(F.nullif("wind_gust", F.lit(0.0)), "wind_speed"), "coalesce(nullif(wind_gust, 0.0), wind_speed)")})
_rowwise("dt_hour_local", "Civil hour and day.", {"hour": (lambda: F.hour(civil("ts_utc")), "hour(hourly.ts_utc + INTERVAL 7 HOUR)::INT"), "day": (lambda: F.to_date(civil("ts_utc")).cast("string"), "(hourly.ts_utc + INTERVAL 7 HOUR)::DATE::VARCHAR")})
_rowwise("dt_to_ict", "Civil time and back.", {"local": (lambda: shown(civil("ts_utc")), "strftime(hourly.ts_utc + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S')"), "back": (lambda: shown(F.to_utc_timestamp(F.from_utc_timestamp("ts_utc", "+07:00"), "+07:00")), "strftime(hourly.ts_utc, '%Y-%m-%d %H:%M:%S')")})
_rowwise("dt_age", "Age in whole minutes and in hours.", {"minutes": (lambda: F.floor((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("ts_utc")) / 60).cast("long"), f"floor(date_diff('second', hourly.ts_utc, TIMESTAMP '{AS_OF}') / 60)::BIGINT"), "hours": (lambda: F.bround((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("ts_utc")) / F.lit(3600.0), 1), f"round_even(date_diff('second', hourly.ts_utc, TIMESTAMP '{AS_OF}') / 3600.0::DOUBLE, 1)")})
_rowwise("arr_build_issues", "Issues that hold, joined.", {"issues": (lambda: F.array_join(F.array_compact(F.array(F.when(F.col("temp") > 35, "hot"), F.when(F.col("humidity") > 90, "humid"), F.when(F.col("pop") > 0.5, "rain"))), ","), "array_to_string(list_filter([CASE WHEN temp > 35 THEN 'hot' END, CASE WHEN humidity > 90 THEN 'humid' END, CASE WHEN pop > 0.5 THEN 'rain' END], lambda x: x IS NOT NULL), ',')")})
_rowwise("str_concat_agg", "Texts joined, nulls left out.", {"line": (lambda: F.concat_ws(", ", "weather_main", F.when(F.col("pop") > 0.5, "rain likely"), "data_kind"), "concat_ws(', ', weather_main, CASE WHEN pop > 0.5 THEN 'rain likely' END, data_kind)")})
_rowwise("fn_conditional_comfort", "Heat index from 27 degrees and 40 % on, wind chill to 10 degrees, else nothing.", {"kind": (lambda: F.when((F.col("temp") >= 27) & (F.col("humidity") >= 40), "heat").when((F.col("temp") <= 10) & (F.col("wind_speed") >= 1.3), "chill"), "CASE WHEN temp >= 27 AND humidity >= 40 THEN 'heat' WHEN temp <= 10 AND wind_speed >= 1.3 THEN 'chill' END")})


@query(DAILY_SQL + "SELECT ward_id, date::VARCHAR AS date, CASE WHEN rain_total = 0 THEN 'Không mưa' WHEN rain_total < 10 THEN 'Mưa nhẹ' WHEN rain_total < 25 THEN 'Mưa vừa' ELSE 'Mưa to' END AS rain FROM daily")
def fn_rain_assessment(spark, sf_dir):
    rain = F.col("rain_total")
    return days_of(spark, sf_dir).select("ward_id", F.col("date").cast("string").alias("date"), F.when(rain == 0, "Không mưa").when(rain < 10, "Mưa nhẹ").when(rain < 25, "Mưa vừa").otherwise("Mưa to").alias("rain"))


@query(DAILY_SQL + "SELECT ward_id, date::VARCHAR AS date, round(temp_max - temp_min + 1e-9, 1) AS temp_range, temp_max - temp_min > 10 AS notable FROM daily")
def fn_temp_range_note(spark, sf_dir):
    spread = F.col("temp_max") - F.col("temp_min")
    return days_of(spark, sf_dir).select("ward_id", F.col("date").cast("string").alias("date"), rounded(spread, 1).alias("temp_range"), (spread > 10).alias("notable"))


@query(_LATEST_CTE + "SELECT district_id, round(max_temp - min_temp + 1e-9, 1) AS spread, max_temp - min_temp > 2 AS notable FROM latest")
def fn_temp_spread(spark, sf_dir):
    spread = F.col("max_temp") - F.col("min_temp")
    return latest_groups(spark, sf_dir).select("district_id", rounded(spread, 1).alias("spread"), (spread > 2).alias("notable"))


@query(_LATEST_CTE + """SELECT a.district_id AS first, b.district_id AS second, round(a.avg_temp - b.avg_temp + 1e-9, 1) AS temp_diff, round(a.avg_humidity - b.avg_humidity + 1e-9, 1) AS humidity_diff, round(a.avg_clouds - b.avg_clouds + 1e-9, 1) AS clouds_diff,
  round(a.avg_rain_1h - b.avg_rain_1h + 1e-9, 1) AS rain_1h_diff, round(a.avg_wind_speed - b.avg_wind_speed + 1e-9, 1) AS wind_speed_diff, CASE WHEN abs(a.avg_temp - b.avg_temp) <= 2 THEN 'similar' WHEN a.avg_temp > b.avg_temp THEN 'warmer' ELSE 'colder' END AS verdict
FROM latest a JOIN latest b ON b.district_id = a.district_id + 1""")
def fn_compare_now(spark, sf_dir):
    """All five differences of each group and the next one, now; `compare_weather` takes any pairs."""
    now = latest_groups(spark, sf_dir).select("district_id", "avg_temp", "avg_humidity", "avg_clouds", "avg_rain_1h", "avg_wind_speed")
    a, b = now.alias("a"), now.alias("b")
    gap = lambda c: F.col(f"a.{c}") - F.col(f"b.{c}")
    verdict = F.when(F.abs(gap("avg_temp")) <= 2, "similar").when(gap("avg_temp") > 0, "warmer").otherwise("colder")
    names = {"avg_temp": "temp_diff", "avg_humidity": "humidity_diff", "avg_clouds": "clouds_diff", "avg_rain_1h": "rain_1h_diff", "avg_wind_speed": "wind_speed_diff"}
    return a.join(b, F.col("b.district_id") == F.col("a.district_id") + 1).select(F.col("a.district_id").alias("first"), F.col("b.district_id").alias("second"), *[rounded(gap(c), 1).alias(name) for c, name in names.items()], verdict.alias("verdict"))


@query(HOURLY_SQL + "SELECT city_id, ts_utc::DATE::VARCHAR AS date, weather_main FROM placed GROUP BY city_id, ts_utc::DATE, weather_main QUALIFY row_number() OVER (PARTITION BY city_id, ts_utc::DATE ORDER BY count(*) DESC, weather_main) = 1")
def agg_mode(spark, sf_dir):
    return mode_of(placed(spark, sf_dir).withColumn("date", F.to_date("ts_utc").cast("string")), ["city_id", "date"], "weather_main")


@query(HOURLY_SQL + "SELECT p.city_id, strftime(p.ts_utc, '%Y-%m-%d %H:%M:%S') AS ts_utc, p.ward_id, m.weather_main AS usual FROM placed p JOIN (SELECT city_id, ts_utc, weather_main FROM placed GROUP BY city_id, ts_utc, weather_main QUALIFY row_number() OVER (PARTITION BY city_id, ts_utc ORDER BY count(*) DESC, weather_main) = 1) m USING (city_id, ts_utc)")
def join_corr_scalar_mode(spark, sf_dir):
    """The most frequent condition of each row's region and hour: the correlated subquery as a join."""
    rows = placed(spark, sf_dir)
    usual = mode_of(rows, ["city_id", "ts_utc"], "weather_main").withColumnRenamed("weather_main", "usual")
    return rows.select("city_id", "ts_utc", "ward_id").join(usual, ["city_id", "ts_utc"]).withColumn("ts_utc", shown("ts_utc"))


@query(HOURLY_SQL + "SELECT city_id, round(degrees(atan2(avg(sin(radians(wind_deg))), avg(cos(radians(wind_deg))))) + 360 + 1e-9, 1) % 360.0::DOUBLE AS direction FROM placed GROUP BY city_id")
def agg_circular_mean(spark, sf_dir):
    return placed(spark, sf_dir).groupBy("city_id").agg(circular_mean("wind_deg").alias("direction"))


@query(HOURLY_SQL + "SELECT city_id, count(*) FILTER (WHERE rain_1h > 0.5) AS rainy, count(*) FILTER (WHERE rain_1h > 1.0) AS very_rainy, count(DISTINCT ward_id) AS n_wards, arg_max(weather_main, (ts_utc, ward_id)) AS last_main FROM placed GROUP BY city_id")
def agg_cond_count(spark, sf_dir):
    order = F.struct("ts_utc", "ward_id")
    return placed(spark, sf_dir).groupBy("city_id").agg(F.count_if(F.col("rain_1h") > 0.5).alias("rainy"), F.count_if(F.col("rain_1h") > 1.0).alias("very_rainy"), F.count_distinct("ward_id").alias("n_wards"), F.max_by("weather_main", order).alias("last_main"))


@query(HOURLY_SQL + "SELECT ward_id, arg_max(weather_main, ts_utc) AS last_main, arg_min(weather_main, ts_utc) AS first_main FROM hourly GROUP BY ward_id")
def agg_first_by_order(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("ward_id").agg(F.max_by("weather_main", "ts_utc").alias("last_main"), F.min_by("weather_main", "ts_utc").alias("first_main"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def agg_count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))


_DAYS = _daily_sql("city_id").replace("\nSELECT city_id, date::VARCHAR", "\n, days AS (SELECT city_id, date::VARCHAR", 1) + ")\n"


@query(_DAYS + "SELECT city_id, round(avg(avg_temp) + 1e-9, 2) AS mean_temp, min(temp_min) AS min_temp, max(temp_max) AS max_temp, round(sum(total_rain) + 1e-9, 2) AS rain, count(*) FILTER (WHERE total_rain > 0.5) AS rain_days, count(*) AS n_days FROM days WHERE date BETWEEN '2024-01-10' AND '2024-01-16' GROUP BY city_id")
def agg_period_stats(spark, sf_dir):
    days = group_days(spark, sf_dir, "city_id", "2024-01-10", "2024-01-16")
    return days.groupBy("city_id").agg(rounded(F.avg("avg_temp"), 2).alias("mean_temp"), F.min("temp_min").alias("min_temp"), F.max("temp_max").alias("max_temp"), rounded(F.sum("total_rain"), 2).alias("rain"), F.count_if(F.col("total_rain") > 0.5).alias("rain_days"), F.count(F.lit(1)).alias("n_days"))


@query(_DAYS + f"SELECT city_id, date, avg_temp FROM days WHERE date >= '{AS_OF[:10]}' QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY date) <= 7")
def flt_dynamic_date(spark, sf_dir):
    """Seven days from the start date, the reference day where none is given."""
    nth = F.row_number().over(Window.partitionBy("city_id").orderBy("date"))
    return group_days(spark, sf_dir, "city_id", AS_OF[:10]).select("city_id", "date", "avg_temp", nth.alias("nth")).where("nth <= 7").drop("nth")


@query(FORECAST_SQL + "SELECT city_id, ts_utc[1:10] AS date, count(*) AS n_rows, min(ts_utc)[12:16] AS first_time, max(ts_utc)[12:16] AS last_time FROM f GROUP BY city_id, ts_utc[1:10]")
def agg_by_day_summary(spark, sf_dir):
    return forecast_series(spark, sf_dir).groupBy("city_id", F.substring("ts_utc", 1, 10).alias("date")).agg(F.count(F.lit(1)).alias("n_rows"), F.substring(F.min("ts_utc"), 12, 5).alias("first_time"), F.substring(F.max("ts_utc"), 12, 5).alias("last_time"))


@query(FORECAST_SQL + "SELECT city_id, count(*) AS n_rows, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts, count(DISTINCT ts_utc[1:10]) AS n_dates, CASE WHEN count(*) >= 48 THEN 'full' ELSE 'partial' END AS coverage FROM f GROUP BY city_id")
def disp_forecast_wrap(spark, sf_dir):
    return forecast_series(spark, sf_dir).groupBy("city_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"), F.count_distinct(F.substring("ts_utc", 1, 10)).alias("n_dates"), F.when(F.count(F.lit(1)) >= 48, "full").otherwise("partial").alias("coverage"))


@query("SELECT c_nationkey AS district_id, arg_min(c_custkey, (c_name, c_custkey)) AS ward_id FROM customer GROUP BY 1")
def disp_rep_ward_fallback(spark, sf_dir):
    return wards(spark, sf_dir).groupBy("district_id").agg(F.min_by("ward_id", F.struct("ward_name", "ward_id")).alias("ward_id"))


@query(HOURLY_SQL + "SELECT ward_id, strftime(max(ts_utc), '%Y-%m-%d %H:%M:%S') AS ts_utc, arg_max(temp, ts_utc) AS temp FROM hourly GROUP BY ward_id")
def top_api_latest(spark, sf_dir):
    """The newest row of each leaf, whatever its kind."""
    return hourly(spark, sf_dir).groupBy("ward_id").agg(shown(F.max("ts_utc")).alias("ts_utc"), F.max_by("temp", "ts_utc").alias("temp"))


@query(HOURLY_SQL + f"SELECT ward_id, strftime(hourly.ts_utc + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_ts, temp, humidity FROM hourly WHERE hourly.ts_utc > TIMESTAMP '{AS_OF}'")
def flt_api_forecast(spark, sf_dir):
    return hourly(spark, sf_dir, since=NEXT_HOUR).select("ward_id", shown(civil("ts_utc")).alias("local_ts"), "temp", "humidity")


@query("SELECT c_custkey AS ward_id, c_name AS ward_name, n_name AS district_name FROM customer JOIN nation ON n_nationkey = c_nationkey ORDER BY n_name, c_name")
def sort_multi(spark, sf_dir):
    """All leaves by group and name: a range-partitioned sort."""
    rows = wards(spark, sf_dir).join(F.broadcast(districts(spark, sf_dir)), "district_id").select("ward_id", "ward_name", "district_name")  # groups number a few dozen
    return rows.orderBy("district_name", "ward_name")


@query(_LATEST_CTE + "SELECT district_id, rank() OVER (ORDER BY avg_temp DESC)::INT AS rank, dense_rank() OVER (ORDER BY avg_temp DESC)::INT AS dense FROM latest")
def win_rank_enumerate(spark, sf_dir):
    window = Window.partitionBy(F.lit(0)).orderBy(F.desc("avg_temp"))  # a row for each group, a few dozen
    return latest_groups(spark, sf_dir).select("district_id", F.rank().over(window).alias("rank"), F.dense_rank().over(window).alias("dense"))


@query("SELECT r_name AS city_name, n_name AS district_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def loc_districts(spark, sf_dir):
    return districts(spark, sf_dir).join(F.broadcast(cities(spark, sf_dir)), "city_id").select("city_name", "district_name")


@query("SELECT c_custkey AS ward_id, c_name AS ward_name FROM customer WHERE c_nationkey = 3")
def loc_wards_in_district(spark, sf_dir):
    return wards(spark, sf_dir).where("district_id = 3").select("ward_id", "ward_name")


@query("SELECT c_custkey AS ward_id, c_name AS ward_name, n_name AS district_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def loc_all_wards(spark, sf_dir):
    return wards(spark, sf_dir).join(F.broadcast(districts(spark, sf_dir)), "district_id").select("ward_id", "ward_name", "district_name")


@query("SELECT c_custkey AS ward_id, c_name AS ward_name FROM customer WHERE c_custkey = 42")
def loc_get_ward(spark, sf_dir):
    return wards(spark, sf_dir).where("ward_id = 42").select("ward_id", "ward_name")


_ENTITY = r"(Phường|Xã|Quận|Huyện|Thị xã) (\p{Lu}\p{L}*( \p{Lu}\p{L}*)*)"


@query(f"""WITH t AS (SELECT o_orderkey, 'Trời ' || o_orderstatus || ' ở ' || CASE o_custkey % 6 WHEN 0 THEN 'Phường ' WHEN 1 THEN 'Xã ' WHEN 2 THEN 'Quận ' WHEN 3 THEN 'Huyện ' WHEN 4 THEN 'Thị xã ' ELSE 'phố ' END || upper(o_orderpriority[3]) || lower(o_orderpriority[4:]) || ' nhé' AS said FROM orders)
SELECT o_orderkey, regexp_extract(said, '{_ENTITY}', 0) AS entity, regexp_extract(said, '{_ENTITY}', 1) AS kind FROM t""")
def str_regex_entity(spark, sf_dir):
    """The first place named with its kind in a sentence; the sentences are made of the orders' columns."""
    kinds = F.element_at(F.array(*map(F.lit, ("Phường ", "Xã ", "Quận ", "Huyện ", "Thị xã ", "phố "))), (F.col("o_custkey") % 6 + 1).cast("int"))
    name = F.concat(F.upper(F.substring("o_orderpriority", 3, 1)), F.lower(F.substring("o_orderpriority", 4, 99)))
    said = F.concat(F.lit("Trời "), "o_orderstatus", F.lit(" ở "), kinds, name, F.lit(" nhé"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    return rows.select("o_orderkey", F.regexp_extract("said", _ENTITY, 0).alias("entity"), F.regexp_extract("said", _ENTITY, 1).alias("kind"))


# The categories of an error and the words that tell them, in order.
ERRORS = (
    ("location_resolution", ("location", "not_found", "ambiguous")), ("data_unavailable", ("no_data", "database", "không có dữ liệu")), ("network", ("timeout", "connection", "refused")), ("llm_api", ("openai", "api", "rate_limit")),
)


def error_category(text: Column) -> Column:
    """The first category with a word in the text, in any case."""
    low, out = F.lower(text), F.lit("unknown")
    for name, words in reversed(ERRORS):
        out = F.when(reduce(Column.__or__, (low.contains(w) for w in words)), name).otherwise(out)
    return out


_ERROR_TEXT = "['Location NOT_FOUND', 'ambiguous place', 'NO_DATA', 'lost the Database', 'Không có dữ liệu', 'Read TIMEOUT', 'connection closed', 'refused', 'OpenAI down', 'API key', 'rate_limit', 'other', 'database connection', 'api location']"


@query(f"SELECT event_id, {_ERROR_TEXT}[user_id % 14 + 1] || ' ' || event_type || ' ' || props AS error, " + "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({_ERROR_TEXT}[user_id % 14 + 1] || ' ' || event_type || ' ' || props), '{w}')" for w in words) + f" THEN '{name}'" for name, words in ERRORS) + " ELSE 'unknown' END AS category FROM events WHERE event_type = 'error'")
def str_error_category(spark, sf_dir):
    """The category of each error event; the message is made of the event's columns."""
    texts = F.array(*[F.lit(t.strip().strip("'")) for t in _ERROR_TEXT.strip("[]").split(",")])
    error = F.concat_ws(" ", F.element_at(texts, (F.col("user_id") % 14 + 1).cast("int")), "event_type", "props")
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", error.alias("error"), error_category(error).alias("category"))


@query("SELECT doc_id, b.item_id, contains(lower(d.text), lower(left(b.text, 30))) AS inside FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)")
def str_entity_contains(spark, sf_dir):
    """Whether each document has the beginning of the passage that goes with its id, in any case."""
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.left("text", F.lit(30)).alias("entity"))
    n = F.lit(passages.count())
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod(F.col("doc_id"), n).alias("item_id"))
    return rows.join(passages, "item_id").select("doc_id", "item_id", F.lower("text").contains(F.lower("entity")).alias("inside"))


@query("SELECT p_partkey, p_name AS answer FROM part")
def str_strip_think(spark, sf_dir):
    wrapped = F.concat(F.lit("<think>a\nb</think>\n "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(wrapped, r"(?s)<think>.*?</think>\s*", "").alias("answer"))


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def js_parse_router(spark, sf_dir):
    """JSON as it is, else the first object in the text."""
    noisy = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("answer: "), "props"))
    parsed = F.coalesce(F.from_json(noisy, "k INT")["k"], F.from_json(F.regexp_extract(noisy, r"(\{[^{}]*\})", 1), "k INT")["k"])
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("k"))


@query("SELECT o_orderkey, CASE WHEN datediff('day', DATE '1998-01-01', o_orderdate::DATE) BETWEEN 0 AND 14 THEN 'valid' ELSE 'too long' END AS range FROM orders")
def dt_valid_range(spark, sf_dir):
    parsed = F.coalesce(F.try_to_timestamp(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("dd/MM/yyyy")))
    days = F.datediff(F.to_date(parsed), F.lit("1998-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(days.between(0, 14), "valid").otherwise("too long").alias("range"))
