"""Scans, look-ups, calendars and activity templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiform.operators.evaluation import _ROWS, rows
from stratiform.registry import query
from stratiform.sources.roles import HOURLY_SQL, rounded, shown, table, wards


@query("SELECT c_custkey AS ward_id, c_name AS ward_name FROM customer")
def src_ward_list(spark, sf_dir):
    return wards(spark, sf_dir).select("ward_id", "ward_name")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10")
def src_table_scan(spark, sf_dir):
    """A parameterised SQL query over a scan."""
    return spark.sql("SELECT p_partkey, p_name, p_size FROM {part} WHERE p_size > :least", args={"least": 10}, part=table(spark, sf_dir, "part"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def src_query_one(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(1).select("p_partkey", "p_name")


@query("SELECT o_orderkey, strftime(o_orderdate - INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS utc, (isodow(o_orderdate) - 1)::INT AS weekday, round(((o_orderkey % 5) * 3600 + 36000) / 3600.0::DOUBLE + 1e-9, 1) AS daylight FROM orders")
def dt_to_utc(spark, sf_dir):
    ts = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", shown(ts - F.expr("INTERVAL 7 HOURS")).alias("utc"), F.weekday(ts).alias("weekday"), rounded(((F.col("o_orderkey") % 5) * 3600 + 36000) / F.lit(3600.0), 1).alias("daylight"))


@query("SELECT DISTINCT o_orderdate::DATE::VARCHAR AS today, k::INT AS shift, (o_orderdate::DATE + k::INT)::VARCHAR AS date, strftime(o_orderdate::DATE + k::INT, '%d/%m/%Y') AS shown FROM orders, range(-2, 3) AS r(k)")
def dt_anchors(spark, sf_dir):
    """Each order's day and two days on either side, as they are stored and as they are shown."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("today")).distinct()
    each = days.select("today", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("shift")).withColumn("date", F.date_add("today", F.col("shift")))
    return each.select(F.col("today").cast("string").alias("today"), "shift", F.col("date").cast("string").alias("date"), F.date_format("date", "dd/MM/yyyy").alias("shown"))


@query("""SELECT today::VARCHAR AS today, k::INT AS day, (today - (isodow(today) - 1)::INT + (k - 7)::INT)::VARCHAR AS date, CASE WHEN k < 7 THEN 'last' WHEN k < 14 THEN 'this' ELSE 'next' END AS week
FROM (SELECT DISTINCT o_orderdate::DATE AS today FROM orders), range(0, 21) AS r(k) WHERE today - (isodow(today) - 1)::INT + (k - 7)::INT <= today + 7""")
def dt_week_tables(spark, sf_dir):
    """Last, this and next week of each order's day, from Monday, up to a week ahead."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("today")).distinct()
    each = days.select("today", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("day"))
    date = F.date_add(F.date_sub("today", F.weekday("today")), F.col("day") - 7)
    week = F.when(F.col("day") < 7, "last").when(F.col("day") < 14, "this").otherwise("next")
    return each.where(date <= F.date_add("today", 7)).select(F.col("today").cast("string").alias("today"), "day", date.cast("string").alias("date"), week.alias("week"))


@query("SELECT user_id AS ward_id, ts::DATE::VARCHAR AS date, round(date_diff('microsecond', min(ts), max(ts)) / 3600e6 + 1e-9, 1) AS hours FROM events GROUP BY user_id, ts::DATE")
def dt_daylight_hours(spark, sf_dir):
    """Hours between the first and the last instant of each leaf's day, which stand for sunrise and sunset."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ward_id"), F.col("ts").cast("timestamp").alias("ts")).groupBy("ward_id", F.to_date("ts").alias("date")).agg(F.min("ts").alias("rise"), F.max("ts").alias("set"))
    return rows.select("ward_id", F.col("date").cast("string").alias("date"), rounded((F.unix_micros("set") - F.unix_micros("rise")) / 3600e6, 1).alias("hours"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS date FROM orders")
def dt_parse_multi(spark, sf_dir):
    """Three formats, the first that parses."""
    d = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "HH:mm dd-MM-yyyy"))
    parsed = F.coalesce(*[F.try_to_timestamp(written, F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "HH:mm dd-MM-yyyy")])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(parsed).cast("string").alias("date"))


@query(_ROWS + "SELECT doc_id, CASE WHEN intent = 'en' THEN NULL ELSE score END AS faithfulness, score AS relevance FROM rows")
def fn_score_histogram_gate(spark, sf_dir):
    """Small talk, for which one language stands here, has no faithfulness."""
    return rows(spark, sf_dir).select("doc_id", F.when(F.col("intent") != "en", F.col("score")).alias("faithfulness"), F.col("score").alias("relevance"))


# Activity and its good temperatures (null: none are named).
TEMPLATES = (
    ("chay_bo", 15, 25), ("dua_dieu", 20, 30), ("picnic", 22, 28), ("bike", 18, 28), ("chup_anh", None, None), ("tap_the_duc", 18, 25), ("du_lich", 20, 32), ("cam_trai", 18, 30),
    ("cau_ca", 15, 35), ("lam_vuon", 18, 32), ("boi_loi", 28, 38), ("leo_nui", 15, 30), ("di_dao", 18, 32), ("su_kien", 20, 32),
)


@query(HOURLY_SQL + """SELECT ward_id, activity, CASE WHEN activity IN ('phoi_do', 'khac') THEN 'default' WHEN activity = 'chup_anh' THEN 'any' ELSE low || '-' || high END AS good
FROM (SELECT DISTINCT ward_id FROM hourly), (VALUES ('chay_bo', 15, 25), ('dua_dieu', 20, 30), ('picnic', 22, 28), ('bike', 18, 28), ('chup_anh', 0, 0), ('tap_the_duc', 18, 25), ('du_lich', 20, 32), ('cam_trai', 18, 30),
 ('cau_ca', 15, 35), ('lam_vuon', 18, 32), ('boi_loi', 28, 38), ('leo_nui', 15, 30), ('di_dao', 18, 32), ('su_kien', 20, 32), ('phoi_do', 0, 0), ('khac', 0, 0)) AS a(activity, low, high)""")
def fn_activity_template(spark, sf_dir):
    """Good temperatures by activity, with a default for activities that have no template."""
    known = F.create_map(*[F.lit(x) for name, low, high in TEMPLATES for x in (name, "any" if low is None else f"{low}-{high}")])
    asked = F.explode(F.array(*[F.lit(name) for name in (*[t[0] for t in TEMPLATES], "phoi_do", "khac")])).alias("activity")
    places = table(spark, sf_dir, "events").select(F.col("user_id").alias("ward_id")).distinct()
    return places.select("ward_id", asked).withColumn("good", F.coalesce(known[F.col("activity")], F.lit("default")))
