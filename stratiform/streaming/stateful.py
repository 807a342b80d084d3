"""Structured Streaming counterparts: watermarked roll-ups, late data by priority, staleness and thread expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.operators.snapshot import upsert


def hourly_rollup(stream: DataFrame, key: str, lateness: str = "30 minutes") -> DataFrame:
    """Hourly means and counts by `key`; rows later than the watermark are dropped, and an hour goes out once it is over."""
    hours = stream.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), key)
    return hours.agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n_rows")).select(F.col("window.start").alias("ts_utc"), key, "avg_value", "max_value", "n_rows")


def sessions(stream: DataFrame, key: str, gap: str = "1 hour", lateness: str = "30 minutes") -> DataFrame:
    """Threads that end after `gap` without a row."""
    return stream.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("last_ts"), key, "n_rows")


def stale(latest: DataFrame, as_of, hours: int = 2) -> DataFrame:
    """`latest` (ts by key) with whether it is older than `hours` at `as_of`."""
    return latest.withColumn("stale", F.col("ts") < as_of - F.expr(f"INTERVAL {hours} HOURS"))


def priority_sink(path: str, keys: list[str], ranks: dict[str, int], arrival: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges each batch by priority into a table under `path`.

    The table is partitioned by a hash of the keys, and only partitions that a batch has keys of are read and replaced.
    What replaces them is written beside the table first. Merging is idempotent, so a batch that comes again after a
    failure, wherever that was, changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([*keys, *arrival]).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        table, staged = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-staged"))
        files = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)) if files.exists(table) else new.limit(0)
        upsert(old, new, [*keys, "bucket"], ranks, arrival).select(new.columns).write.mode("overwrite").parquet(f"{path}-staged")
        merged = spark.read.schema(new.schema).parquet(f"{path}-staged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        files.delete(staged, True)

    return merge
