"""The tools' parameters, cases without data, and the rules that the tables' month does not show."""

import pytest
from pyspark.sql import functions as F

from stratiform.operators import advice, runs, snapshot
from stratiform.plans import levels, tools

SF = "/root/testdata/sf0.001"


def test_a_place_is_the_same_as_in_all_places(spark):
    every = tools.get_hourly_forecast(spark, SF).collect()
    for level in levels.LEVELS:
        place = next(r["place_id"] for r in every if r["level"] == level)
        one = tools.get_hourly_forecast(spark, SF, levels=(level,), place=place).collect()
        assert sorted(one) == sorted(r for r in every if (r["level"], r["place_id"]) == (level, place)) and one
    assert tools.get_hourly_forecast(spark, SF, place=10**9).count() == 0
    with pytest.raises(ValueError, match="levels"):
        levels.series(spark, SF, levels=("street",))


def test_hours_are_clamped(spark):
    assert tools.get_hourly_forecast(spark, SF, levels=("city",), hours=1000).agg(F.max("nth")).first()[0] == 48
    assert tools.get_hourly_forecast(spark, SF, levels=("city",), hours=0).agg(F.max("nth")).first()[0] == 1


def test_metrics_that_are_none_are_refused(spark):
    for ask in (lambda: tools.get_district_ranking(spark, SF, metric="x"), lambda: tools.get_ward_ranking_in_district(spark, SF, metric="mua"), lambda: tools.get_district_multi_compare(spark, SF, metrics="x, y")):
        with pytest.raises(ValueError):
            ask()
    assert tools.get_district_multi_compare(spark, SF, metrics="may, x,diem_suong").columns == ["district_name", "may", "diem_suong"]


def test_rankings_in_both_orders(spark):
    rows = spark.createDataFrame([(f"d{i}", float(i % 4), i) for i in range(10)], "district_name string, avg_temp double, ward_count int")
    assert [r["district_name"] for r in snapshot.ranking(rows, "nhiet_do", True, 3).orderBy("rank").collect()] == ["d3", "d7", "d2"]
    assert [r["district_name"] for r in snapshot.ranking(rows, "nhiet_do", False, 99).orderBy("rank").collect()][:3] == ["d0", "d4", "d8"]


def test_a_place_is_not_compared_with_itself(spark):
    now = tools.compare_weather(spark, SF).where("level = 'ward'").first()
    pairs = spark.createDataFrame([("ward", now["first"], now["first"]), ("ward", now["first"], now["second"]), ("ward", now["first"], 10**9)], "level string, first long, second long")
    assert [r["second"] for r in tools.compare_weather(spark, SF, pairs).collect()] == [now["second"]]


def test_alerts_of_every_level(spark):
    found = {r["level"] for r in tools.get_weather_alerts(spark, SF, ("city", "district", "ward")).collect()}
    assert found == {"city", "district", "ward"}
    regions = {(r["place_id"], r["ts_utc"], r["alert"]) for r in tools.get_weather_alerts(spark, SF, levels=("city",)).collect()}
    of = {r["district_id"]: r["city_id"] for r in tools.districts(spark, SF).collect()}
    assert regions == {(of[r["place_id"]], r["ts_utc"], r["alert"]) for r in tools.get_weather_alerts(spark, SF, levels=("district",)).collect()}
    with pytest.raises(ValueError):
        tools.get_weather_alerts(spark, SF, levels=("village",))


def test_damp_spells_of_spring(spark):
    hours = [(1, f"2024-{m:02d}-10 {h:02d}:00:00", temp, dew, hum) for m, temp, dew, hum in ((1, 20.0, 19.0, 95.0), (3, 20.0, 18.0, 85.0), (4, 20.0, 17.9, 95.0), (5, 20.0, 20.0, 99.0)) for h in (1, 2)]
    rows = spark.createDataFrame(hours, "city_id int, ts_utc string, avg_temp double, avg_dew_point double, avg_humidity double")
    assert [(r["first_ts"], r["n_rows"], r["least_spread"]) for r in runs.nom_am(rows).collect()] == [("2024-03-10 01:00:00", 2, 2.0)]


def test_windows_of_both_kinds(spark):
    rows = spark.createDataFrame([(1, f"t{i}", u) for i, u in enumerate([3.0, 5.0, None, 6.0, 9.0, 9.0, 1.0])], "city_id int, ts_utc string, max_uvi double")
    got = sorted((r["first_ts"], r["last_ts"], r["kind"], r["peak_uvi"], r["peak_ts"]) for r in runs.uv_windows(rows).collect())
    assert got == [("t0", "t1", "safe", 9.0, "t4"), ("t3", "t5", "danger", 9.0, "t4"), ("t6", "t6", "safe", 9.0, "t4")]
    assert runs.uv_windows(rows.where("max_uvi IS NULL")).count() == 0
    low = spark.createDataFrame([(1, f"t{i}", 1000.0 + i if i % 2 else None) for i in range(6)], "city_id int, ts_utc string, avg_pressure double")
    assert [(r["coverage"], r["enough"], r["trend"]) for r in runs.pressure_drop(low).collect()] == [(50.0, False, "rising")]


def test_activity_profiles(spark):
    rows = spark.createDataFrame([(33.0, 70.0, 0.0, 1.0, 3.0, 4.0, 50.0, "Clear"), (20.0, 70.0, 0.0, 1.0, 1.0, None, 90.0, "Clouds"), (None, None, None, None, None, None, None, "Thunderstorm"), (14.0, 95.0, 0.6, 9.0, 13.0, 15.0, 10.0, "Rain")],
                                 "temp double, humidity double, pop double, uvi double, wind_speed double, wind_gust double, clouds double, weather_main string")
    got = {(r["weather_main"], r["activity"]): (r["issues"], r["verdict"]) for r in advice.activity_advice(rows, ["chay_bo", "dua_dieu", "chup_anh", "su_kien", "leo_nui"]).collect()}
    assert got["Clear", "chay_bo"] == ("heat", "khong_nen") and got["Clear", "leo_nui"] == ("hot", "co_the") and got["Clear", "dua_dieu"] == ("", "nen")
    assert got["Clouds", "dua_dieu"] == ("calm", "co_the") and got["Clouds", "chup_anh"] == ("dull", "co_the")
    assert all(got["Thunderstorm", a][1] == "khong_nen" and "storm" in got["Thunderstorm", a][0] for a in ("chay_bo", "dua_dieu", "leo_nui"))
    assert got["Rain", "su_kien"] == ("uv, rain_danger, wind", "khong_nen") and got["Rain", "chup_anh"] == ("uv, rain, wind, glare", "han_che")
    scores = advice.scored(rows.withColumn("ts_utc", F.lit("t")), [], ["xyz", "chay_bo"]).groupBy("activity").agg(F.sort_array(F.collect_list("score")).alias("s"))
    assert len({tuple(r["s"]) for r in scores.collect()}) == 1  # an unknown activity is judged as a run, hours without a temperature not at all


def test_the_last_rows_are_read_from_their_hours_on(spark, tmp_path):
    found = tools.latest(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "FileScan" in line and "events.parquet" in line and "props" in line]
    assert len(wide) == 1 and "GreaterThanOrEqual(ts" in wide[0] and plan.count("Window") == 0
    own = {(r["level"], r["place_id"]): r["ts_utc"] for r in found.collect()}
    rows = tools.series(spark, SF, until=tools.NEXT_HOUR).groupBy("level", "place_id").agg(F.max("ts_utc").alias("t")).collect()
    assert own == {(r["level"], r["place_id"]): r["t"] for r in rows}
    one = tools.latest(spark, SF, ("district", "city"), place=1).collect()
    assert {(r["level"], r["ts_utc"]) for r in one} == {(level, t) for (level, place), t in own.items() if place == 1 and level != "ward"}
