"""Lines of files as rows with a reject channel: what cannot be read is kept beside what can, and both are counted as they are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STATUSES = ("good", "blank", "broken")


@dataclass(frozen=True)
class Read:
    """`rows` are the good ones with their file; `rejects` (file, status, line) the others. `seen` has the counts of STATUSES once
    `lines` has been run through an action: they add up to the number of lines."""

    lines: DataFrame
    rows: DataFrame
    rejects: DataFrame
    seen: Observation

    def counts(self) -> dict[str, int]:
        """The counts, from a pass over the lines."""
        self.lines.write.format("noop").mode("overwrite").save()
        return {s: self.seen.get[s] for s in STATUSES}


def _split(lines: DataFrame, parsed: Column, schema: str, header: Column | None = None) -> Read:
    bare = F.trim(F.regexp_replace("line", "﻿", ""))
    rows = lines.withColumn("row", parsed).where(~header if header is not None else F.lit(True))
    status = F.when(bare == "", "blank").when(F.col("row").isNull() | F.col("row._bad").isNotNull(), "broken").otherwise("good")
    seen = Observation()
    marked = rows.withColumn("status", status)
    counted = marked.observe(seen, *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    good = marked.where("status = 'good'").select("file", "row.*").drop("_bad")
    return Read(counted, good, marked.where("status <> 'good'").select("file", "status", "line"), seen)


def _lines(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    return reader.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> Read:
    """JSON lines: a line that is no object, or has a value that does not fit its column, is broken."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_json("line", f"{schema}, _bad string", options)
    return _split(_lines(spark, path, pattern), F.when(F.trim("line").startswith("{"), parsed), schema)


def csv_lines(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> Read:
    """CSV whose records take a line each, with a header that names the columns of `schema`: a line with more or fewer columns, or with
    a value that does not fit, is broken. Quotes and a byte order mark are understood; header lines are not counted."""
    lines = _lines(spark, path, pattern)
    names = spark.createDataFrame([], schema).columns
    header = F.regexp_replace("line", '[﻿"\\s]', "") == ",".join(names)
    parsed = F.from_csv("line", F.lit(f"{schema}, _bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"'})
    return _split(lines, parsed, schema, header)


def newest(read: DataFrame) -> DataFrame:
    """The rows that come from the last file by name."""
    last = read.agg(F.max("file").alias("file"))
    return read.join(F.broadcast(last), "file")  # one row


# The columns of the two logs of telemetry, and of the classifier's samples.
CONVERSATION_LOG = "timestamp timestamp, session_id string, user_query string, llm_response string, response_time_ms double"
TOOL_LOG = "timestamp timestamp, session_id string, tool_name string, success boolean, execution_time_ms double"
SAMPLES = "model string, gt_intent string, pred_intent string, pred_conf string, route_ok string"


def telemetry(spark: SparkSession, path: str) -> tuple[Read, Read]:
    """The logs of conversations and of tool calls below `path`."""
    return csv_lines(spark, path, CONVERSATION_LOG, "conversations*.csv"), csv_lines(spark, path, TOOL_LOG, "tool_calls*.csv")


def samples(spark: SparkSession, path: str) -> Read:
    """A classifier's samples: an empty confidence is 0, one that is no number null, and only `true` in any case is right."""
    read = csv_lines(spark, path, SAMPLES)
    sure = F.when(F.coalesce(F.trim("pred_conf"), F.lit("")) == "", 0.0).otherwise(F.expr("try_cast(pred_conf AS double)"))
    rows = read.rows.select("file", "model", F.col("gt_intent").alias("gt"), F.col("pred_intent").alias("pred"), sure.alias("conf"), F.coalesce(F.lower("route_ok") == "true", F.lit(False)).alias("ok"))
    return Read(read.lines, rows, read.rejects, read.seen)
