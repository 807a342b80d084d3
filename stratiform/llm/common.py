"""What the corpus operators share: scratch tables, Arrow text buffers, distributed ranks."""

from __future__ import annotations

import atexit
import functools
import inspect
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one rank chunk; a chunk is ranked by one task.
CHUNK_ROWS = 50_000
#: Chunks at least, so that small inputs spread over the executors too.
MIN_CHUNKS = 256
#: Shuffle files of a query go when it ends: what it made is in the table by then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders of the tables that `written` made, and the folder of each that is still in use.
_TABLES: list[str] = []
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. On a local master, and only there, one of our own
    where that is unset: the executors of a cluster would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="stratiform-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: cuts the lineage, and survives lost executors.

    The table goes with `release`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratiform-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if not _TABLES:
        atexit.register(release, spark)
    folder = path.rpartition("/")[0]
    _TABLES.append(folder)
    table = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave and of which everything that is read from them is written by now."""
    for table in tables:
        folder = _FOLDERS.pop(table, None)
        if folder in _TABLES:
            _TABLES.remove(folder)
            _delete(table.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Deletes the tables of all results so far, which can be read no more: a long session calls it between queries."""
    while _TABLES and spark.sparkContext._jsc is not None:
        _delete(spark, _TABLES.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_names(counts: bool = False) -> Callable:
    """For a stage (df, ..., id_col, text_col) that gives back the columns of `df`: it gets them under plain names, so that no column of
    the caller's can be taken for one of the stage's own, whatever it is called. With `counts` the column `n_chars`, if there is
    one, counts the characters of the text that the stage leaves."""

    def around(stage: Callable) -> Callable:
        shape = inspect.signature(stage)

        @functools.wraps(stage)
        def run(*args, **named) -> DataFrame:
            bound = shape.bind(*args, **named)
            bound.apply_defaults()
            given = bound.arguments
            first = next(iter(given))
            df = given[first]
            plain = {name: f"own_{i}" for i, name in enumerate(df.columns)}
            text = plain[given["text_col"]]
            given |= {first: df.toDF(*plain.values()), "id_col": plain[given["id_col"]], "text_col": text}
            out = stage(*bound.args, **bound.kwargs).select(*plain.values())
            if counts and "n_chars" in plain:
                out = out.withColumn(plain["n_chars"], F.length(text).cast(df.schema["n_chars"].dataType))
            return out.toDF(*df.columns)

        return run

    return around


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer text has a range to itself."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def grouped(batches: Iterator[pa.RecordBatch], text_at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about `limit` bytes of text; a longer text has a batch to itself."""
    held, size = [], 0
    for batch in batches:
        for lo, hi in slices(utf8(batch.column(text_at))[1], limit):
            part = batch.slice(lo, hi - lo)
            own = int(utf8(part.column(text_at))[1][-1])
            if held and size + own > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from table.to_batches()


def planes(values: np.ndarray, width: int) -> bytes:
    """The `width` low bytes of each number, all first bytes first: equal high bytes then compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def size_of(text: str | Column) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def ranked(df: DataFrame, group: str, order: list[str], rank: str, n_rows: int) -> DataFrame:
    """Adds `rank`: gapless from 0 within each `group`, by (hash chunk of `order`, `order`).

    No task ranks a whole group: rows fall into chunks by a hash of `order`, chunks get their offsets from
    counts, and each chunk is ranked for itself. `df` is read twice, so it should be a written table.
    """
    chunks = max(MIN_CHUNKS, -(-n_rows // CHUNK_ROWS))
    marked = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(group, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(group, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__chunk").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    placed = marked.withColumn("__row", F.row_number().over(inside) - 1)
    return placed.join(starts, [group, "__chunk"]).withColumn(rank, F.col("__start") + F.col("__row")).drop("__chunk", "__row", "__start")
