"""The streaming operators over the events as they are stored: each query reads them as a stream, to its end, into a table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratiform.registry import query
from stratiform.sources.roles import shown, table
from stratiform.streaming import keyed, stateful

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark) -> str:
    """A new folder that all executors share: below `spark.checkpoint.dir`, or on a local master, where that is unset, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='stratiform-')}/stream-{uuid.uuid4().hex}"


def events(spark, sf_dir) -> DataFrame:
    """The events as a stream."""
    stored = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(stored).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append", sink=None) -> DataFrame | None:
    """Runs a stream over all that is there and gives its rows; with `sink`, a function of (batch, number), that gets them instead."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
        run = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{out}/rows").start()
        run.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return None if sink else spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("""SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts_utc, round(avg(value), 6) AS avg_value, max(value) AS max_value, count(*) AS n_rows FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE GROUP BY user_id, date_trunc('hour', ts)""")
def st_hourly_rollup(spark, sf_dir):
    """Hours that the watermark has passed, each once."""
    rows = finished(stateful.hourly_rollup(events(spark, sf_dir), "user_id"))
    return rows.select("user_id", shown("ts_utc").alias("ts_utc"), F.round("avg_value", 6).alias("avg_value"), "max_value", "n_rows")


@query("""SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, arg_max(event_type, (rank, ts, event_id)) AS data_kind, arg_max(event_id, (rank, ts, event_id)) AS event_id
FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS rank FROM events WHERE event_type IN ('purchase', 'signup', 'click')) GROUP BY user_id, date_trunc('hour', ts)""")
def st_late_priority(spark, sf_dir):
    """One row for each key and hour, by rank of its kind and then by arrival, merged batch by batch."""
    rows = events(spark, sf_dir).where("event_type IN ('purchase', 'signup', 'click')").select("user_id", F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("data_kind"), "ts", "event_id")
    out = scratch(spark) + "/table"
    finished(rows, "update", stateful.priority_sink(out, ["user_id", "hour"], {"purchase": 3, "signup": 2, "click": 1}, ["ts", "event_id"]))
    return spark.read.schema(rows.schema).parquet(out).select("user_id", shown("hour").alias("hour"), "data_kind", "event_id")


@query("""WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM events), gaps AS (SELECT * FROM g WHERE ts - last >= INTERVAL 2 HOUR)
SELECT user_id, strftime(last + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS ts, 'silent' AS kind FROM gaps UNION ALL SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 'returned' FROM gaps""")
def st_stale_flag(spark, sf_dir):
    """When each place fell silent for two hours and when it returned; a silence that is still on is left out."""
    rows = finished(keyed.silences(events(spark, sf_dir), "user_id"))
    last = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "kind")).isNull()
    return rows.withColumn("open", last & (F.col("kind") == "silent")).where("NOT open").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "kind")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM g),
t AS (SELECT user_id, ts, row_number() OVER w AS turn_count, lag(event_id, 1) OVER w AS a, lag(event_id, 2) OVER w AS b, lag(event_id, 3) OVER w AS c FROM p WINDOW w AS (PARTITION BY user_id, part ORDER BY ts, event_id))
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, turn_count::INT AS turn_count, concat_ws(',', c, b, a) AS history FROM t""")
def st_thread_ttl(spark, sf_dir):
    """The up to three rows that each row's thread still remembers; a thread is forgotten after an hour."""
    turns = events(spark, sf_dir).select("user_id", "ts", F.col("event_id").cast("string").alias("user"), F.col("event_type").alias("assistant"))
    rows = finished(keyed.threads(turns, "user_id")).where("kind = 'turn'")
    return rows.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "turn_count", F.array_join("history.user", ",").alias("history"))
