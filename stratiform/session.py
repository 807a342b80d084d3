"""Session defaults shared by the entry points, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; `conf` adds or overrides settings (dots as `__`)."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(master).appName("stratiform").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
