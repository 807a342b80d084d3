"""Operators on small tables whose results are plain to see, nulls and ties included."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratiform.functions import bands, stats, text
from stratiform.operators.rollup import mode_of
from stratiform.operators.runs import runs
from stratiform.operators.snapshot import upsert
from stratiform.sources.roles import latest_of
from stratiform.streaming import stateful


def test_mode_counts_nulls_and_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (2, None), (2, None), (2, "z")], "k int, v string")
    assert {tuple(r) for r in mode_of(df, ["k"], "v").collect()} == {(1, "a"), (2, None)}


def test_runs_follow_neighbouring_rows(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([True, True, False, None, True, False, True])], "city_id int, ts_utc int, x boolean")
    found = runs(df, F.col("x")).groupBy("run").agg(F.sort_array(F.collect_list("ts_utc")).alias("t")).collect()
    assert sorted(r["t"] for r in found) == [[0, 1], [4], [6]]


def test_upsert_keeps_higher_ranks_and_rows_without_a_kind(spark):
    schema = "k int, data_kind string, v int"
    old = spark.createDataFrame([(1, "history", 1), (2, "forecast", 1), (3, None, 1), (4, "current", 1)], schema)
    new = spark.createDataFrame([(1, "forecast", 2), (2, "current", 2), (3, "history", 2), (4, "current", 2), (5, "forecast", 2)], schema)
    got = upsert(old, new, ["k"], {"history": 3, "current": 2, "forecast": 1}, [])
    assert {(r["k"], r["v"]) for r in got.collect()} == {(1, 1), (2, 2), (3, 1), (4, 2), (5, 2)}


def test_latest_of_an_empty_table(spark):
    assert latest_of(spark.createDataFrame([], "k int, t int, v int"), ["k"], ["t"]).count() == 0


@pytest.mark.parametrize("degrees,name", [(0, "Bắc"), (22, "Bắc"), (23, "Đông Bắc"), (359, "Bắc"), (180, "Nam"), (None, "Không xác định")])
def test_octant(spark, degrees, name):
    assert spark.createDataFrame([(degrees,)], "d int").select(bands.octant(F.col("d"))).first()[0] == name


def test_names(spark):
    df = spark.createDataFrame([("  Đống   Đa ",), (None,), ("Cầu Giấy",)], "n string")
    assert [r[0] for r in df.select(text.normalized(F.col("n"))).collect()] == ["dong da", "", "cau giay"]
    pair = spark.createDataFrame([("cau giay", "cau giai")], "a string, b string")
    assert pair.select(text.similarity(text.trigrams(F.col("a")), text.trigrams(F.col("b")))).first()[0] == pytest.approx(7 / 11)


def test_statistics(spark):
    low, high = spark.range(1).select(*stats.wilson(F.lit(8), F.lit(10))).first()
    assert (low, high) == (49.0, 94.3)
    assert stats.mcnemar(10, 2)[0] == pytest.approx(49 / 12) and stats.mcnemar(0, 0) == (0.0, 1.0)
    assert stats.wilcoxon(55, 0, 10) < 0.01 and stats.wilcoxon(5, 5, 0) == 1.0
    assert stats.stars(0.0001) == "***" and stats.stars(0.2) == "n.s."
    assert spark.range(1).select(stats.by_index(F.array(*map(F.lit, [1, 2, 3, 4])), 0.5)).first()[0] == 3
    assert spark.range(1).select(stats.scaled(F.lit(0.8), 1.0)).first()[0] == pytest.approx(0.8)
    assert math.isclose(spark.range(1).select(bands.heat_index(F.lit(35.0), F.lit(70))).first()[0], 50.3, abs_tol=0.3)


def test_streamed_rollup_equals_the_batch(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h, m), k, float(h * m)) for h in range(6) for m in (0, 20, 40) for k in (1, 2)]
    spark.createDataFrame(rows, "ts timestamp, k int, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k int, value double").parquet(str(tmp_path / "in"))
    run = stateful.hourly_rollup(stream, "k").writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("rolled").count() == 12 and spark.table("rolled").agg(F.sum("n_rows")).first()[0] == 36


def test_priority_sink_takes_late_data_by_rank(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = stateful.priority_sink(out, ["k"], {"history": 3, "forecast": 1}, ["n"], buckets=4)
    schema = "k int, data_kind string, n int"
    sink(spark.createDataFrame([(k, "history" if k == 1 else "forecast", 1) for k in range(20)], schema), 0)
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("bucket=*/*.parquet")}
    for _ in range(2):  # a batch that is written again changes nothing
        sink(spark.createDataFrame([(1, "forecast", 2), (2, "forecast", 2)], schema), 1)
    got = {(r["k"], r["data_kind"], r["n"]) for r in spark.read.schema(schema).parquet(out).collect()}
    assert got == {(k, "history" if k == 1 else "forecast", 2 if k == 2 else 1) for k in range(20)}
    assert sum(p.exists() and p.stat().st_mtime_ns == t for p, t in untouched.items()) >= 2  # of four buckets two at most have the keys
    sink(spark.createDataFrame([], schema), 2)
    assert spark.read.schema(schema).parquet(out).count() == 20


def _streamed(spark, tmp_path, batches, make, name):
    """The rows of a query in append mode, fed one file a batch."""
    source = tmp_path / f"{name}-in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, k int, value double").coalesce(1).write.mode("append").parquet(str(source / f"part={i}"))
    stream = spark.readStream.schema("ts timestamp, k int, value double, part int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
    run = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    return spark.table(name).collect()


def test_hours_go_out_once_and_late_rows_are_dropped(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [[(at(0, 10), 1, 1.0), (at(0, 50), 1, 3.0)], [(at(2, 0), 1, 5.0)], [(at(2, 5), 1, 6.0)], [(at(0, 20), 1, 100.0), (at(2, 10), 1, 7.0)], [(at(5, 0), 1, 0.0)]]
    got = {r["ts_utc"].hour: (r["n_rows"], r["max_value"]) for r in _streamed(spark, tmp_path, batches, lambda s: stateful.hourly_rollup(s, "k"), "hours")}
    assert got == {0: (2, 3.0), 2: (3, 7.0)}  # the row of 0:20 came after its hour was over; hour 5 is still open


def test_threads_end_after_their_gap(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [[(at(0, 0), 1, 0.0), (at(0, 40), 1, 0.0), (at(0, 30), 2, 0.0)], [(at(6, 0), 3, 0.0)], [(at(9, 0), 3, 0.0)]]
    got = {(r["k"], r["first_ts"].hour): r["n_rows"] for r in _streamed(spark, tmp_path, batches, lambda s: stateful.sessions(s, "k"), "threads")}
    assert got == {(1, 0): 2, (2, 0): 1, (3, 6): 1}


def test_stale_rows(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 10)), (2, datetime(2024, 1, 1, 7, 59)), (3, None)], "k int, ts timestamp")
    assert [r["stale"] for r in stateful.stale(df, F.lit("2024-01-01 10:00:00").cast("timestamp")).orderBy("k").collect()] == [False, True, None]


def test_rollups_scan_once_with_their_bounds(spark):
    from stratiform import catalog

    for name, bound in (("agg_district_hourly", False), ("win_rain_periods", True), ("flt_future", True), ("fn_alert_rules", True), ("top_district_ranking", True), ("orch_run_aggregation", False), ("get_hourly_forecast", True), ("get_daily_forecast", True), ("agg_period_stats", True), ("agg_superlatives", True), ("flt_dynamic_date", True), ("flt_api_forecast", True), ("join_common_dates", False)):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and "events.parquet" in line]
        assert len(scans) == 1, (name, len(scans))
        assert ("GreaterThanOrEqual(ts" in scans[0]) == bound, (name, scans[0][-600:])


def test_paired_statistics(spark):
    from stratiform.operators import evaluation

    rows = [(True, False, 5, 3)] * 10 + [(False, True, 2, 3)] * 2 + [(True, True, 4, 4)] * 9 + [(True, True, None, 4)]
    df = spark.createDataFrame(rows, "a_ok boolean, b_ok boolean, a_score int, b_score int")
    r = evaluation.mcnemar(df).first()
    assert (r["b"], r["c"], r["chi2"]) == (10, 2, 4.0833) and r["p_value"] == pytest.approx(math.erfc(math.sqrt(49 / 24)), abs=2e-6) and r["significant"]
    assert evaluation.mcnemar(df.where("a_ok AND b_ok")).first()["p_value"] == pytest.approx(1.0, abs=1e-6)
    w = evaluation.wilcoxon(df).first()
    # Ten differences of 2 and two of -1: ranks 7.5 and 1.5.
    assert (w["n"], w["n_different"], w["w_plus"], w["w_minus"]) == (21, 12, 75.0, 3.0)
    assert w["p_value"] == pytest.approx(stats.wilcoxon(75, 3, 12, 10**3 - 10 + 2**3 - 2), abs=2e-6)
    assert evaluation.wilcoxon(df.limit(5)).first()["p_value"] is None
    assert spark.range(1).select(stats.two_sided(F.lit(1.959964))).first()[0] == pytest.approx(0.05, abs=1e-6)


def test_tool_scores(spark):
    from stratiform.operators import evaluation

    rows = [("en", "ward", ["t1", "t2", "resolve_location"]), ("en", "city", ["t9"]), ("es", "city", []), ("en", "city", []), ("xx", "city", ["t9"]), ("fr", "poi", ["t4", "t3", "t9"]), ("en", "city", ["resolve_location"])]
    got = [(r["accurate"], r["precision"], r["recall"]) for r in evaluation.tool_scores(spark.createDataFrame(rows, "intent string, scope string, tools array<string>").coalesce(1)).collect()]
    assert got == [(True, 0.5, 1.0), (False, 0.0, 0.0), (True, 1.0, 1.0), (False, 0.0, 0.0), (True, 0.0, 1.0), (True, 0.67, 1.0), (False, 1.0, 0.0)]


def test_files(spark, tmp_path):
    from stratiform.sources import files

    (tmp_path / "a.csv").write_text("﻿k,name\n1,Hồ\n2,Đống\n", encoding="utf-8")
    assert [tuple(r) for r in files.csv_dimension(spark, str(tmp_path / "a.csv"), "k int, name string").collect()] == [(1, "Hồ"), (2, "Đống")]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "c1_1.jsonl").write_text('{"k": 1}\n\nbroken\n{"k": 2}\n')
    (tmp_path / "runs" / "c1_2.jsonl").write_text('{"k": 3}\n')
    rows = files.json_lines(spark, str(tmp_path / "runs"), "k int", pattern="c1_*.jsonl")
    assert sorted(r["k"] for r in rows.collect()) == [1, 2, 3] and [r["k"] for r in files.newest(rows).collect()] == [3]
    out = str(tmp_path / "out")
    files.append_new(spark.range(3), out, "id")
    files.append_new(spark.range(5), out, "id")
    assert sorted(r["id"] for r in spark.read.json(out).collect()) == [0, 1, 2, 3, 4]
    files.append_log(spark.createDataFrame([("x" * 900,)], "t string"), str(tmp_path / "log"), "t")
    assert len(spark.read.option("header", True).csv(str(tmp_path / "log")).first()["t"]) == 500
    assert files.violations(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"]).count() == 1
    assert files.conform(spark.range(1), spark.createDataFrame([], "id int, more string").schema).dtypes == [("id", "int"), ("more", "string")]


def test_best_and_worst_hours_of_every_activity(spark):
    from stratiform import catalog
    from stratiform.operators.advice import ACTIVITIES

    rows = catalog.queries()["top_best_hours"](spark, "/root/testdata/sf0.001").collect()
    sides = {}
    for r in rows:
        sides.setdefault((r["activity"], r["ward_id"]), []).append(r["side"])
    assert {a for a, _ in sides} == {a[0] for a in ACTIVITIES}
    assert any(s.count("worst") == 3 for s in sides.values())
    assert all(s.count("worst") == (3 if s.count("best") > 3 else 0) for s in sides.values())
