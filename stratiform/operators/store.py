"""Stored tables that change: merges with counts by action, a versioned cache, and declared constraints checked in one pass."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stratiform.registry import query
from stratiform.sources.roles import table
from stratiform.streaming.runs import scratch

ACTIONS = ("inserted", "updated", "deleted", "unchanged", "missing")
BUCKETS = 64


# ---------------------------------------------------------------- merges


def merge(path: str, changes: DataFrame, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> dict[str, int]:
    """Applies `changes` to the table under `path` and gives the rows affected by each of ACTIONS.

    A change has all columns of the table and an `action`: `upsert` writes the whole row, `update` those of its columns that are
    not null, if the row is there, and `delete` takes the row away. Of several changes with one key the last by `order` counts. An
    update or delete of a row that is not there is `missing`; a row that a change leaves as it was is `unchanged`.

    The table is partitioned by a hash of the keys. Only partitions with changed keys are read and replaced, what replaces them is
    written beside the table first, and the counts are observed on that write. The same changes applied again leave the same rows.
    """
    spark, columns = changes.sparkSession, [c for c in changes.columns if c not in ("action", order)]
    rest = [c for c in columns if c not in keys]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    last = changes.groupBy(*keys).agg(F.max(F.struct(*([order] if order else []), "action", *rest)).alias("new")).select(*keys, "new", bucket.alias("bucket"))
    last = last.persist()
    touched = [r[0] for r in last.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return dict.fromkeys(ACTIONS, 0)
    where, staged = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-staged"))
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = changes.select(*columns, F.lit(0).alias("bucket")).schema
    old = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(touched)) if files.exists(where) else changes.select(*columns, bucket.alias("bucket")).limit(0)
    both = old.withColumn("old", F.struct(*rest)).select(*keys, "bucket", "old").join(last, [*keys, "bucket"], "full")
    action, there = F.col("new.action"), F.col("old").isNotNull()
    patched = F.struct(*[F.when(action == "update", F.coalesce(f"new.{c}", f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in rest])
    row = F.when(F.col("new").isNull(), F.col("old")).when((action == "upsert") | ((action == "update") & there), patched)
    done = (
        F.when(F.col("new").isNull(), None).when(~there & (action != "upsert"), "missing").when(action == "delete", "deleted").when(~there, "inserted")
        .when(F.col("row").eqNullSafe(F.col("old")), "unchanged").otherwise("updated")
    )
    seen = Observation()
    merged = both.withColumn("row", row).withColumn("done", done).observe(seen, *[F.count_if(F.col("done") == a).alias(a) for a in ACTIONS])
    merged.select(*keys, "bucket", "row").write.mode("overwrite").parquet(f"{path}-staged")
    kept = spark.read.parquet(f"{path}-staged").where("row IS NOT NULL").select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in columns], "bucket")
    # Partitions that lose all their rows are not in what is written, so they go first.
    full = {r[0] for r in kept.select("bucket").distinct().collect()}
    for gone in set(touched) - full:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={gone}"), True)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    files.delete(staged, True)
    last.unpersist()
    return {a: seen.get[a] for a in ACTIONS}


_CONVERSATIONS = "conv_id long, title string, last_role string, n_turns long, updated_at long"


def conversations(spark, sf_dir) -> DataFrame:
    """A row for each conversation: its title is the beginning of its first text."""
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.left(F.min_by("text", "turn"), F.lit(40)).alias("title"), F.max_by("role", "turn").alias("last_role"), F.count(F.lit(1)).alias("n_turns"), (F.max("turn") * 1000 + F.col("conv_id") % 1000).alias("updated_at"))


def _changes(saved: DataFrame) -> DataFrame:
    """Deletes, partial updates, upserts and rows that are not there, chosen by the id; some keys change twice."""
    k, none = F.col("conv_id") % 7, F.lit(None).cast("string")
    first = saved.select(
        F.when(k == 5, F.col("conv_id") + 1_000_000).when(k == 6, -1 - F.col("conv_id")).otherwise(F.col("conv_id")).alias("conv_id"),
        F.when(k.isin(1, 6), none).when(k == 3, F.col("title")).otherwise(F.concat(F.lit("new "), "title")).alias("title"), F.when(k.isin(1, 6), none).otherwise(F.col("last_role")).alias("last_role"),
        F.when(k == 3, F.col("n_turns")).otherwise(F.col("n_turns") + 1).alias("n_turns"), F.when(k == 3, F.col("updated_at")).otherwise(F.col("updated_at") + 500).alias("updated_at"),
        F.when(k == 0, "delete").when(k.isin(1, 6), "update").otherwise("upsert").alias("action"), F.lit(1).alias("at"), k.alias("k"),
    )
    again = first.where("k = 2 AND conv_id % 2 = 0").withColumns({"action": F.lit("delete"), "at": F.lit(2)})
    return first.where("k <> 4").unionByName(again.where("k <> 4")).drop("k")


def _merged(spark, sf_dir) -> tuple[str, dict[str, int]]:
    path, saved = f"{scratch(spark)}/conversations", conversations(spark, sf_dir)
    merge(path, saved.withColumn("action", F.lit("upsert")), ["conv_id"])
    return path, merge(path, _changes(saved), ["conv_id"], "at")


_SAVED_SQL = "WITH s AS (SELECT conv_id, arg_min(left(text, 40), turn) AS title, arg_max(role, turn) AS last_role, count(*) AS n_turns, max(turn) * 1000 + conv_id % 1000 AS updated_at FROM conversations GROUP BY conv_id)\n"


@query(_SAVED_SQL + """SELECT conv_id + CASE WHEN conv_id % 7 = 5 AND x = 1 THEN 1000000 ELSE 0 END AS conv_id, CASE WHEN conv_id % 7 = 2 OR (conv_id % 7 = 5 AND x = 1) THEN 'new ' || title ELSE title END AS title, last_role,
  n_turns + CASE WHEN conv_id % 7 IN (1, 2) OR (conv_id % 7 = 5 AND x = 1) THEN 1 ELSE 0 END AS n_turns, updated_at + CASE WHEN conv_id % 7 IN (1, 2) OR (conv_id % 7 = 5 AND x = 1) THEN 500 ELSE 0 END AS updated_at
FROM s, (SELECT unnest([0, 1]) AS x) WHERE (x = 0 OR conv_id % 7 = 5) AND conv_id % 7 <> 0 AND NOT (conv_id % 7 = 2 AND conv_id % 2 = 0)""")
def ups_conversation(spark, sf_dir):
    """Saved conversations after upserts, partial updates and deletes, the last changed first."""
    return spark.read.schema(_CONVERSATIONS).parquet(_merged(spark, sf_dir)[0]).drop("bucket").orderBy(F.desc("updated_at"), "conv_id")


@query(_SAVED_SQL + """SELECT unnest(['inserted', 'updated', 'deleted', 'unchanged', 'missing']) AS action, unnest([count(*) FILTER (WHERE k = 5), count(*) FILTER (WHERE k = 1 OR (k = 2 AND conv_id % 2 = 1)), count(*) FILTER (WHERE k = 0 OR (k = 2 AND conv_id % 2 = 0)), count(*) FILTER (WHERE k = 3), count(*) FILTER (WHERE k = 6)]) AS n FROM (SELECT *, conv_id % 7 AS k FROM s)""")
def sink_execute(spark, sf_dir):
    """The rows that a write affected, by action, as observed on the write."""
    return spark.createDataFrame(list(_merged(spark, sf_dir)[1].items()), "action string, n long")


# ---------------------------------------------------------------- cache


def cache_key(*parts: str | Column, version: str) -> Column:
    """The key of an answer: a hash of what it depends on and of the rubric's version."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts], F.lit(version)), 256), 1, 32)


def cache_write(answers: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Stores (key, score, error) as table `name` under `path`, bucketed and sorted by key; an answer without a score or with an error is not kept,
    and of several with one key the least score is."""
    good = answers.where("score IS NOT NULL AND error IS NULL").groupBy("key").agg(F.min("score").alias("score"))
    good.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").format("parquet").option("path", path).saveAsTable(name)


def cache_lookup(asked: DataFrame, name: str) -> DataFrame:
    """`asked` (key and others) with `score` and `hit`. The requests are dealt by the cache's buckets; the cache itself does not move."""
    cached = asked.sparkSession.table(name).withColumnRenamed("score", "cached").withColumn("hit", F.lit(True))
    return asked.hint("merge").join(cached, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).withColumnRenamed("cached", "score")


def cache_misses(asked: DataFrame, name: str) -> DataFrame:
    return asked.hint("merge").join(asked.sparkSession.table(name), "key", "left_anti")


@query("""SELECT conv_id, turn, turn % 2 = 0 AND turn % 3 <> 2 AND length(text) % 5 <> 0 AS hit, CASE WHEN turn % 2 = 0 AND turn % 3 <> 2 AND length(text) % 5 <> 0 THEN (length(text) % 5)::INT END AS score FROM conversations""")
def join_cache_lookup(spark, sf_dir):
    """Which turns a cache of scores holds under the present version of the rubric: those of even number were judged, some by an older
    version and some without success."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    parts, size = ("conv_id", "turn", F.substring(F.sha2("text", 256), 1, 16), "role"), F.char_length("text")
    old = F.col("turn") % 3 == 2
    judged = rows.where("turn % 2 = 0").select(F.when(old, cache_key(*parts, version="v1")).otherwise(cache_key(*parts, version="v2")).alias("key"), (size % 5).cast("int").alias("score"), F.when(size % 5 == 0, "failed").alias("error"))
    name = f"stratiform_cache_{uuid.uuid4().hex}"
    cache_write(judged, name, f"{scratch(spark)}/cache")
    return cache_lookup(rows.select("conv_id", "turn", cache_key(*parts, version="v2").alias("key")), name).select("conv_id", "turn", "hit", "score")


# ---------------------------------------------------------------- constraints


@dataclass(frozen=True)
class Table:
    """What holds for a table: columns with their types, keys that are unique, columns that are never null, references (column: the
    table and column where its values stand), domains (name: a rule that is true or null), and bounds of its number of rows."""

    name: str
    columns: dict[str, str]
    unique: tuple[tuple[str, ...], ...] = ()
    filled: tuple[str, ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()
    domains: tuple[tuple[str, str], ...] = ()
    rows: tuple[int, int | None] = (0, None)


SCHEMA = (
    Table("region", {"r_regionkey": "int", "r_name": "string"}, (("r_regionkey",), ("r_name",)), ("r_name",), rows=(1, 100)),
    Table("nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, (("n_nationkey",),), ("n_name",), (("n_regionkey", "region", "r_regionkey"),), rows=(1, 1000)),
    Table("customer", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int"}, (("c_custkey",), ("c_name",)), ("c_name",), (("c_nationkey", "nation", "n_nationkey"),), (("name", "c_name LIKE 'Customer#%'"),), (1, None)),
    Table("events", {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double"}, (("event_id",), ("user_id", "event_type")), ("ts",), (("user_id", "customer", "c_custkey"),), (("value", "value >= 1"), ("type", "event_type IN ('click', 'view', 'purchase')")), (1, None)),
)


def create(spark, tables: tuple[Table, ...], database: str, drop: bool = False) -> list[str]:
    """Creates the tables that are not there, and adds columns that stored ones lack; with `drop` it begins anew. Gives the statements
    that changed something, so a second run gives none."""
    done = []

    def run(statement: str) -> None:
        spark.sql(statement)
        done.append(statement)

    if not spark.catalog.databaseExists(database):
        run(f"CREATE DATABASE {database}")
    for t in tables:
        name = f"{database}.{t.name}"
        if drop and spark.catalog.tableExists(name):
            run(f"DROP TABLE {name}")
        if not spark.catalog.tableExists(name):
            run(f"CREATE TABLE {name} ({', '.join(f'{c} {kind}' for c, kind in t.columns.items())}) USING parquet")
        elif missing := [f"{c} {kind}" for c, kind in t.columns.items() if c not in spark.table(name).columns]:
            run(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(missing)})")
    return done


def violations(spec: Table, load) -> DataFrame:
    """(table, rule, violations) of every rule of a table, from one aggregate over it; `load` gives a table by its name.

    Rows without a counterpart are found in the same pass: each reference is a left join with the different values there. A missing
    or differently typed column is a violation of its own, and rules that need it are left out.
    """
    rows = load(spec.name)
    kinds = {f.name: f.dataType.simpleString().replace("_ntz", "") for f in rows.schema}
    wrong = {c for c, kind in spec.columns.items() if kinds.get(c) != kind}
    rules = {f"column {c}": F.lit(int(c in wrong)) for c in spec.columns}
    for i, (column, other, key) in enumerate(spec.references):
        if column not in wrong:
            there = load(other).select(F.col(key).alias(f"key{i}")).where(F.col(f"key{i}").isNotNull()).distinct().withColumn(f"there{i}", F.lit(True))
            rows = rows.join(there, F.col(column) == F.col(f"key{i}"), "left")
            rules[f"reference {column}"] = F.count_if(F.col(column).isNotNull() & F.col(f"there{i}").isNull())
    for columns in spec.unique:
        if not wrong & set(columns):
            whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
            rules[f"unique {', '.join(columns)}"] = F.count_if(whole) - F.count_distinct(F.when(whole, F.struct(*columns)))
    rules |= {f"filled {c}": F.count_if(F.col(c).isNull()) for c in spec.filled if c not in wrong}
    rules |= {f"domain {name}": F.count_if(~F.expr(rule)) for name, rule in spec.domains if not any(c in rule for c in wrong)}
    least, most = spec.rows
    n = F.count(F.lit(1))
    rules["rows"] = (n < least).cast("int") + (F.lit(0) if most is None else (n > most).cast("int"))
    found = rows.agg(*[rule.cast("long").alias(f"r{i}") for i, rule in enumerate(rules.values())])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)]))
    return found.select(F.lit(spec.name).alias("table"), each.alias("x")).select("table", "x.*")


def _violations_sql() -> str:
    parts = []
    for t in SCHEMA:
        one = lambda rule, value, where="": parts.append(f"SELECT '{t.name}' AS \"table\", '{rule}' AS rule, {value}::BIGINT AS violations{where}")  # noqa: E731, B023
        for c in t.columns:
            one(f"column {c}", "0")
        for c, other, key in t.references:
            one(f"reference {c}", "count(*)", f" FROM {t.name} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {key} FROM {other})")
        for columns in t.unique:
            one(f"unique {', '.join(columns)}", "coalesce(sum(n - 1), 0)", f" FROM (SELECT count(*) AS n FROM {t.name} GROUP BY {', '.join(columns)})")
        for c in t.filled:
            one(f"filled {c}", "count(*)", f" FROM {t.name} WHERE {c} IS NULL")
        for name, rule in t.domains:
            one(f"domain {name}", "count(*)", f" FROM {t.name} WHERE NOT ({rule})")
        one("rows", f"(count(*) < {t.rows[0]})::INT + {0 if t.rows[1] is None else f'(count(*) > {t.rows[1]})::INT'}", f" FROM {t.name}")
    return " UNION ALL ".join(parts)


@query(_violations_sql())
def orch_verify_dim(spark, sf_dir):
    """What of the declared rules the tables break; two of the rules for events are broken by design of the data."""
    return reduce(DataFrame.unionByName, (violations(t, lambda name: table(spark, sf_dir, name)) for t in SCHEMA))
