"""Stored roll-ups: a run with bounds leaves the same tables as a run over everything."""

from collections import Counter

import pytest

from stratiform import catalog
from stratiform.operators import materialise
from stratiform.plans import levels
from tests.oracle import _plain

SF = "/root/testdata/sf0.001"
TABLES = ("district_hourly", "city_hourly", "district_daily", "city_daily")


def _rows(spark, out, name):
    rows = spark.read.parquet(f"{out}/{name}")
    return Counter(tuple(_plain(r[c]) for c in sorted(rows.columns)) for r in rows.collect())


def _all(spark, out):
    return {name: _rows(spark, out, name) for name in TABLES}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    counts = materialise.run_aggregation(spark, SF, out)
    return out, counts, _all(spark, out)


def test_the_tables_equal_the_queries(spark, whole):
    out, counts, _ = whole
    want = {(r["city_id"], r["ts_utc"]): (r["avg_temp"], r["weather_main"], r["avg_wind_deg"]) for r in catalog.queries()["agg_city_hourly_forecast"](spark, SF).collect()}
    rows = materialise.stored(spark, out, "city_hourly", since="2024-01-20").where("data_kind = 'forecast'")
    got = {(r["city_id"], r["ts_utc"].strftime("%Y-%m-%d %H:%M:%S")): (r["avg_temp"], r["weather_main"], r["avg_wind_deg"]) for r in rows.collect()}
    assert got == want and "PartitionFilters: [isnotnull(day" in rows._jdf.queryExecution().toString()
    tasks = {r["task"]: r["records"] for r in catalog.queries()["orch_run_aggregation"](spark, SF).collect()}
    assert set(tasks) == set(counts) and all(counts[t] <= n for t, n in tasks.items())
    for name in TABLES:
        assert sum(n for t, n in counts.items() if t.startswith(name)) == spark.read.parquet(f"{out}/{name}").count()


@pytest.mark.parametrize("bounds", [("2024-01-12 00:00:00", "2024-01-13 00:00:00"), ("2024-01-12 09:00:00", "2024-01-12 15:30:00"), ("2024-01-19 17:00:00", "2024-01-20 17:00:00"), (None, "2024-01-02 00:00:00"), ("2024-01-29 23:00:00", None)])
def test_a_bounded_run_changes_nothing_that_is_up_to_date(spark, whole, bounds):
    out, _, before = whole
    counts = materialise.run_aggregation(spark, SF, out, since=bounds[0], until=bounds[1])
    assert 0 < sum(counts.values()) < sum(sum(t.values()) for t in before.values())
    assert _all(spark, out) == before


def test_parts_in_any_order_make_the_whole(spark, whole, tmp_path):
    out = str(tmp_path)
    for since, until in (("2024-01-20 00:00:00", None), (None, "2024-01-09 05:00:00"), ("2024-01-09 05:00:00", "2024-01-20 00:00:00")):
        materialise.run_aggregation(spark, SF, out, since=since, until=until)
    assert _all(spark, out) == whole[2]


def test_late_facts_reach_their_days_only(spark, whole, tmp_path):
    """A run over the day of new facts leaves the tables that a run over all facts makes."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    sf = tmp_path / "sf"
    for name in ("customer", "nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(sf / f"{name}.parquet"))
    events.where("ts < '2024-01-12 16:00:00' OR ts >= '2024-01-12 18:00:00'").write.parquet(str(sf / "events.parquet"))
    out = str(tmp_path / "out")
    materialise.run_aggregation(spark, str(sf), out)
    assert _all(spark, out) != whole[2]
    events.where("ts >= '2024-01-12 16:00:00' AND ts < '2024-01-12 18:00:00'").write.mode("append").parquet(str(sf / "events.parquet"))
    materialise.run_aggregation(spark, str(sf), out, since="2024-01-12 16:00:00", until="2024-01-12 18:00:00")
    assert _all(spark, out) == whole[2]


def test_a_run_of_one_kind_keeps_the_others(spark, whole):
    out, _, before = whole
    counts = materialise.run_aggregation(spark, SF, out, hourly_kinds=("history",), daily_kinds=())
    assert set(counts) == {"district_hourly_history", "city_hourly_history"} and _all(spark, out) == before


def test_stored_series_equal_those_of_facts(spark, whole):
    out = whole[0]
    since, until = "2024-01-21 00:00:00", "2024-01-23 07:00:00"
    for level in ("district", "city"):
        stored, own = levels.stored_series(spark, out, level, since=since, until=until), levels.series(spark, SF, (level,), since=since, until=until)
        assert sorted(map(str, stored.collect())) == sorted(map(str, own.collect())) and stored.count() > 0
        stored, own = levels.stored_days(spark, out, level, place=1, since="2024-01-22", until="2024-01-25"), levels.days(spark, SF, (level,), place=1).where("date BETWEEN '2024-01-22' AND '2024-01-24'")
        assert sorted(map(str, stored.collect())) == sorted(map(str, own.collect()))
    with pytest.raises(ValueError):
        levels.series(spark, SF, ("village",))
