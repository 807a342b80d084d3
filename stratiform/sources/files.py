"""File sources and sinks: CSV dimensions, JSON lines good and broken, appended logs, resumable output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_dimension(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV with a header; a byte order mark before the first column's name does no harm, as the schema names it."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = True, pattern: str | None = None) -> DataFrame:
    """JSON lines; `tolerant` leaves out blank and broken lines, else they raise. `pattern` filters file names."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).json(path)


def newest(df: DataFrame) -> DataFrame:
    """The rows that come from the last file by name."""
    named = df.withColumn("__file", F.input_file_name())
    last = named.agg(F.max("__file").alias("__file"))
    return named.join(F.broadcast(last), "__file").drop("__file")  # one row


def append_log(df: DataFrame, path: str, text_col: str, longest: int = 500) -> None:
    """Appends rows as CSV, with a text cut to `longest` characters."""
    df.withColumn(text_col, F.substring(text_col, 1, longest)).write.mode("append").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends as JSON the rows whose key is not in `path` yet, and gives them; a rerun appends nothing."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    new = df.join(spark.read.schema(df.schema).json(path).select(key), key, "left_anti") if there else df
    new.write.mode("append").json(path)
    return new


def report(df: DataFrame, path: str, title: str | None = None) -> None:
    """A small result as JSON, one file, and with a `title` as a Markdown table beside it. Doubles have four digits."""
    df.coalesce(1).write.mode("overwrite").json(path)
    if title is not None:
        markdown(df, title).write.mode("overwrite").text(f"{path}-markdown")


def markdown(df: DataFrame, title: str) -> DataFrame:
    """(value): the lines of a small result as a Markdown table, in one partition, in the order of its rows."""
    cells = [F.coalesce(F.format_string("%.4f", c) if kind == "double" else F.col(c).cast("string"), F.lit("–")) for c, kind in df.dtypes]
    line = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rows = df.select(line([F.regexp_replace(c, r"\|", r"\\|") for c in cells]).alias("value"))
    return df.sparkSession.createDataFrame([(x,) for x in head], "value string").coalesce(1).union(rows.coalesce(1)).coalesce(1)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """`df` with exactly the columns of `schema`: missing ones are null, others go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
