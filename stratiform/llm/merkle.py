"""A Merkle manifest of a data set: a tree over each group's rows, a root over the groups, and a proof for every row.

Leaves are numbered within their group in order of id: the rows are dealt by ranges of (group, id) and sorted there, and
each range's rows of a group are numbered on from those of the ranges before it. The tree is built from the bottom:
`FANOUT` neighbours meet by their number and become their hash, level by level, each level a written table of runs
(parent, its nodes). The groups' last nodes are the leaves of one more tree. Proofs come down the same tables: a run joins
the proof of its parent from the level above, and each of its nodes prepends its siblings to that. A proof is an array of
(left, right), the siblings on either side joined, from the leaf's own level up; `folded` gives the root that a leaf has
under it. Rows that meet are `FANOUT` nodes of one run at most, whatever the sizes of the groups, and of the texts only
hashes leave the scan.

Defined results: a null value is written `-`; a null group and a null id are values that come first; rows that are equal in
group and id stand in the order of their leaves; a group of one row has its leaf as its node, and a last run of one node is hashed like
any other; a text of any length is hashed where it is read and does not move; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.llm.common import written
from stratiform.llm.resampling import CRC_TABLE, crc32_sql

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of the remainders of an id's crc32 by this number, 0 marks the rows that the query tampers with.
TAMPERED_ONE_IN = 3


def leaf(columns: dict[str, Column]) -> Column:
    """The hash of a row: its values in order, each with its length, so that no two rows read alike."""
    text = {name: value.cast("string") for name, value in columns.items()}
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text.values()]), 256)


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`rows` with `idx`, their place from 0 among those that share the first column of `order`, and `n`, how many do."""
    group, by = order[0], [F.col(c).asc_nulls_first() for c in order]
    # The number of a row is its range's number in the upper bits and its place within the range in the lower ones.
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = written(dealt, name).withColumn("range", F.shiftright("at", 33))
    found = placed.groupBy("range", F.col(group).alias("own")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("own")
    before = F.sum("size").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = found.select(F.col("range").alias("of"), "own", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    met = placed.join(starts, (F.col("range") == F.col("of")) & F.col(group).eqNullSafe(F.col("own")))
    return met.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "range", "of", "own", "shift")


def climb(leaves: DataFrame, keep: Sequence[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(runs of each level from the leaves up, (tree, level, hash) of each tree's last node).

    `leaves` holds (tree, idx, n, hash) and the columns `keep`, which the nodes of the lowest runs carry. A tree that is down
    to one node is not hashed again.
    """
    levels, nodes, tops = [], leaves, [leaves.where("n = 1").select("tree", F.lit(0).alias("level"), "hash")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        node = F.struct("idx", "hash", *([] if levels else keep))
        runs = nodes.where("n > 1").groupBy("tree", "n", F.floor(F.col("idx") / fanout).cast("long").alias("parent")).agg(F.sort_array(F.collect_list(node)).alias("nodes"))
        levels.append(written(runs.withColumn("hash", F.sha2(F.array_join("nodes.hash", ""), 256)), "runs"))
        nodes = levels[-1].select("tree", F.col("parent").alias("idx"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), "hash")
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "hash"))
        most = -(-most // fanout)
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return levels, out


def push(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame, keep: Sequence[str], down: Sequence[str]) -> DataFrame:
    """(tree, hash, `keep`, proof, `down`) of every leaf. `tops` holds (tree, level, proof, `down`) of each tree's last node:
    its own proof goes on to all that is below it, and so do the columns `down`."""
    above = None
    for level in range(len(levels), 0, -1):
        parents = tops.where(F.col("level") == level).select(F.col("tree").alias("of"), F.lit(0).cast("long").alias("own"), "proof", *down)
        if above is not None:
            parents = parents.unionByName(above.select(F.col("tree").alias("of"), F.col("idx").alias("own"), "proof", *down))
        runs = levels[level - 1].select("tree", "parent", "nodes")
        met = runs.join(parents, F.col("tree").eqNullSafe(F.col("of")) & (F.col("parent") == F.col("own")))
        each = met.select("tree", "proof", *down, F.col("nodes.hash").alias("all"), F.posexplode("nodes").alias("at", "node"))
        own = F.struct(F.array_join(F.slice("all", 1, F.col("at")), "").alias("left"), F.array_join(F.slice("all", F.col("at") + 2, F.size("all")), "").alias("right"))
        above = each.select("tree", "node.*", F.concat(F.array(own), "proof").alias("proof"), *down)
    lone = tops.where("level = 0").select(F.col("tree").alias("of"), "proof", *down)
    alone = leaves.where("n = 1").join(lone, F.col("tree").eqNullSafe(F.col("of"))).select("tree", "hash", *keep, "proof", *down)
    return alone if above is None else alone.unionByName(above.select("tree", "hash", *keep, "proof", *down))


def manifest(df: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", extra: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, proof) of each row, and the columns `extra`, computed where the row is read."""
    extra = extra or {}
    keep, own = ("id", *(f"extra_{i}" for i in range(len(extra)))), leaf({c: F.col(c) for c in columns})
    read = df.select(F.col(group_col).alias("tree"), F.col(id_col).alias("id"), own.alias("hash"), *[value.alias(f"extra_{i}") for i, value in enumerate(extra.values())])
    leaves = numbered(written(read, "leaves"), ("tree", "id", "hash"), "placed")
    levels, tops = climb(leaves, keep, fanout)
    groups = numbered(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("of_group"), "level", "hash"), ("tree", "of_group"), "groups").withColumnRenamed("level", "of_level")
    last, top = climb(groups, ("of_group", "of_level"), fanout)
    empty = F.array().cast("array<struct<left: string, right: string>>")
    start = top.select("tree", "level", empty.alias("proof"), F.col("hash").alias("root"))
    roots = push(last, start, groups, ("of_group", "of_level"), ("root",))
    tops = roots.select(F.col("of_group").alias("tree"), F.col("of_level").alias("level"), "proof", F.col("hash").alias("subroot"), "root")
    out = push(levels, tops, leaves, keep, ("subroot", "root"))
    return out.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "proof", *[F.col(f"extra_{i}").alias(name) for i, name in enumerate(extra)])


def folded(leaf: Column | str, proof: Column | str) -> Column:
    """The root that `leaf` has under `proof`."""
    return F.aggregate(proof, F.col(leaf) if isinstance(leaf, str) else leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def siblings(proof: Column | str) -> Column:
    """All hashes of a proof in order, as one text."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "")


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), where some rows are read as if tampered with:
    their texts' A-Z in lower case."""
    values = {c: F.col(c) for c in COLUMNS}
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_ONE_IN == 0
    out = manifest(df, extra={"tampered": F.when(hit, leaf(values | {"text": lower}))})
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), "proof"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("proof"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _levels_sql(name: str, first: str, levels: int) -> str:
    """The levels of the trees over `first` (tree, idx, n, hash): their runs, and the nodes of the next level."""
    parts, nodes = [], first
    for k in range(levels):
        parts.append(f"{name}_runs_{k} AS MATERIALIZED (SELECT tree, n, idx // 8 AS parent, list(hash ORDER BY idx) AS hashes FROM {nodes} GROUP BY ALL)")
        nodes = f"{name}_{k}"
        parts.append(f"{nodes} AS (SELECT tree, (n + 7) // 8 AS n, parent AS idx, CASE WHEN n = 1 THEN hashes[1] ELSE sha256(array_to_string(hashes, '')) END AS hash FROM {name}_runs_{k})")
    return ", ".join(parts)


def _fold_sql(name: str, first: str, prefix: str, levels: int) -> str:
    """`first` (tree, idx, cur, proof and others) folded over the runs of each level."""
    parts, rows = [], first
    for k in range(levels):
        sides = "array_to_string(hashes[1 : idx % 8], '') AS l, array_to_string(hashes[idx % 8 + 2 :], '') AS r"
        parts.append(f"{name}_{k} AS (SELECT * EXCLUDE (l, r, n) REPLACE (idx // 8 AS idx, CASE WHEN n = 1 THEN cur ELSE sha256(l || cur || r) END AS cur, CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof) FROM (SELECT f.*, n, {sides} FROM {rows} f JOIN {prefix}_runs_{k} g ON f.tree IS NOT DISTINCT FROM g.tree AND f.idx // 8 = g.parent))")
        rows = f"{name}_{k}"
    return ", ".join(parts)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in (*COLUMNS[:-1], text)) + ")"


#: Levels of the trees of the oracle: 8^7 rows of a group, 64 groups.
_DEEP, _WIDE = 7, 2
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE_SQL = f"""
WITH {CRC_TABLE},
hashed AS MATERIALIZED (
  SELECT doc_id, lang AS tree, {_leaf_sql("text")} AS hash, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(_LOWER)} END AS tampered
  FROM documents, crc),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{_levels_sql("up", "leaves", _DEEP)},
groups AS MATERIALIZED (SELECT 0 AS tree, tree AS own, hash, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up_{_DEEP - 1}),
{_levels_sql("top", "groups", _WIDE)},
begun AS (SELECT doc_id, tree, hash AS leaf, coalesce(tampered, hash) AS cur, '' AS proof, idx FROM leaves),
{_fold_sql("leaf", "begun", "up", _DEEP)},
joined AS (SELECT f.doc_id, f.leaf, f.cur, f.proof, 0 AS tree, g.idx, g.hash AS subroot FROM leaf_{_DEEP - 1} f JOIN groups g ON f.tree IS NOT DISTINCT FROM g.own),
{_fold_sql("group", "joined", "top", _WIDE)}
SELECT doc_id, leaf, subroot, hash AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = hash AS verified
FROM group_{_WIDE - 1} g JOIN top_{_WIDE - 1} t ON t.tree = g.tree
"""
