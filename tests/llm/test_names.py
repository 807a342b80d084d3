"""Stages give back what they got, whatever the caller's columns are called."""

import pytest
from pyspark.sql import functions as F

from stratiform.llm import lines, shingles, simhash, suffixes, toxicity

PASSAGE = "this passage of well over fifty bytes stands in several documents word for word and stays once\n"
ROWS = [(1, PASSAGE + "one"), (2, PASSAGE + "one"), (3, None), (4, "something else entirely, of no interest to anyone at all"), (None, PASSAGE + "two")]
#: Names that the stages, what is below them, or Spark use for columns of their own.
NAMES = ["__id", "__tag", "__doc", "__kept", "__spans", "__matches", "__n_lines", "__n_removed", "__stays", "own_0", "own_1", "id", "tag", "doc", "line", "h", "fp", "node", "least", "spans", "score", "predicted", "a.b", "c`d", "n_chars"]


def _stages(spark):
    labels = spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, toxic int")
    return {
        "toxicity": lambda df, **ids: toxicity.keep_clean(df, labels.withColumnRenamed("doc_id", ids.get("id_col", "doc_id")), **ids), "lines": lines.dedup, "suffixes": suffixes.dedup, "shingles": shingles.dedup, "simhash": simhash.dedup,
    }


@pytest.mark.parametrize("stage", ["toxicity", "lines", "suffixes", "shingles", "simhash"])
def test_clashing_columns_come_back(spark, stage):
    run, bare = _stages(spark)[stage], spark.createDataFrame(ROWS, "doc_id long, text string")
    wide = bare.select("*", *[F.lit(i).alias(name) for i, name in enumerate(NAMES)])
    got = run(wide)
    assert got.columns == wide.columns and [f.dataType for f in got.schema] == [f.dataType for f in wide.schema]
    plain = sorted(map(str, run(bare).collect()))
    assert sorted(map(str, got.select("doc_id", "text").collect())) == plain
    for row in got.collect():
        cells = list(row)[2:]
        assert cells[:-1] == list(range(len(NAMES) - 1))
        assert cells[-1] == (len(NAMES) - 1 if stage not in ("lines", "suffixes") else None if row["text"] is None else len(row["text"]))


@pytest.mark.parametrize("stage", ["toxicity", "lines", "suffixes", "shingles", "simhash"])
def test_id_and_text_may_have_names_of_the_stages(spark, stage):
    run, bare = _stages(spark)[stage], spark.createDataFrame(ROWS, "doc_id long, text string")
    got = run(bare.toDF("__doc" if stage != "toxicity" else "key", "body"), id_col="__doc" if stage != "toxicity" else "key", text_col="body")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, run(bare).collect()), key=str)
