"""Connected components of a graph whose links live in a DataFrame, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u long, v long); root is the least node reachable.

    Large-star steps hang a node's larger neighbours on its least one, small-star steps its smaller ones, until
    nothing changes: a logarithmic number of rounds in practice. No neighbourhood is gathered into one row; a hub's
    least neighbour is a partial aggregate, and its links meet it in a join that adaptive execution can split.
    Self-links and repeated links are harmless; an empty table gives an empty result.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.where("u <> v").distinct(), "links")
        discard(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def place(id_col: str, tag_col: str) -> Column:
    """The order of documents: by id, null last, then by the text's hash."""
    return F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(tag_col).alias("tag"))


def labelled(each: DataFrame, trees: DataFrame) -> DataFrame:
    """(node, least): the least place of each node's component; `each` holds (node, place), `trees` comes from `components`.

    Written, so that a join of documents with it has plain tables on both sides and a node of very many copies can be split.
    """
    in_tree = trees.join(each, "node")
    least = in_tree.groupBy("root").agg(F.min("place").alias("least"))
    named = in_tree.join(least, "root").select(F.col("node").alias("__node"), "least")
    return written(each.join(named, F.col("node") == F.col("__node"), "left").select("node", F.coalesce("least", "place").alias("least")), "labels")


def keep_one(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `df` at the least place of their component, and of rows equal in id and text any one.

    `found` holds (id, tag, least) for each row, the tag being the text's xxhash64.
    """
    found = written(found.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("tag") == F.col("least.tag"))).alias("__stays")), "found")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__tag"))
    kept = df.join(found.where("not __stays").select("__id", "__tag").distinct(), same, "left_anti").select(df.columns)
    again = written(found.where("__stays").groupBy("__id", "__tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id", "__tag"), "again")
    if again.isEmpty():
        return kept
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
