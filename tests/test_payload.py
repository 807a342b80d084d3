"""Stored JSON, whole, in part and broken."""

import json
from datetime import datetime

from stratiform.sources import payload


def test_payloads_become_hours(spark):
    full = {"lat": 1, "current": {"dt": 1705730400, "temp": 20.5, "humidity": 80, "weather": [{"main": "Rain", "description": "x"}], "rain": {"1h": 0.4}}, "hourly": [{"dt": 1705734000, "temp": 21, "pop": 0.3, "weather": []}, {"temp": 5}, {"dt": 1705737600}]}
    df = spark.createDataFrame([(1, json.dumps(full)), (2, json.dumps({"hourly": None})), (3, "no json"), (4, None), (5, json.dumps({"current": {"dt": 1705730400}}))], "ward_id int, payload string")
    got = [(r["ward_id"], r["data_kind"], r["ts_utc"], r["temp"], r["humidity"], r["pop"], r["rain_1h"], r["weather_main"]) for r in payload.hours(df).orderBy("ward_id", "ts_utc").collect()]
    assert got == [
        (1, "current", datetime(2024, 1, 20, 6), 20.5, 80, None, 0.4, "Rain"), (1, "forecast", datetime(2024, 1, 20, 7), 21.0, None, 0.3, 0.0, None), (1, "forecast", datetime(2024, 1, 20, 8), None, None, None, 0.0, None),
        (5, "current", datetime(2024, 1, 20, 6), None, None, None, 0.0, None),
    ]


def test_messages_become_calls(spark):
    messages = [
        {"role": "user", "content": "?"},
        {"role": "assistant", "content": "", "tool_calls": [{"id": "a", "name": "f", "args": {"x": 1}}, {"id": "b", "name": "g", "args": {}}]},
        {"role": "tool", "tool_call_id": "b", "content": '{"Error": 1}'}, {"role": "tool", "tool_call_id": "a", "content": "fine"},
        {"role": "assistant", "content": "", "tool_calls": [{"id": "c", "name": "f", "args": None}]},
    ]
    df = spark.createDataFrame([("q1", json.dumps(messages)), ("q2", json.dumps(messages[:1])), ("q3", "broken"), ("q4", None)], "question_id string, messages string")
    got = [(r["question_id"], r["place"], r["name"], r["args"], r["output"], r["success"]) for r in payload.tool_calls(df).orderBy("place").collect()]
    assert got == [("q1", 0, "f", {"x": "1"}, "fine", True), ("q1", 1, "g", {}, '{"Error": 1}', False), ("q1", 2, "f", None, None, False)]


def test_answers_of_routers_and_judges(spark):
    texts = ['{"intent": "a", "scope": "city", "confidence": 1.5}', 'sure: {"intent": "b", "confidence": 0} ok', '<think>{"intent": "no"}</think>```json\n{"intent": "c"}\n```', "nothing", None]
    got = [(r["intent"], r["scope"], r["confidence"]) for r in payload.routed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, raw string")).orderBy("k").collect()]
    assert got == [("a", "city", 0.99), ("b", None, 0.01), ("c", None, 0.9), (None, None, None), (None, None, None)]
    scores = ['```json\n{"score": 4}\n```', 'I say {"score": 5}.', '{"score": 6}', '{"score": "x"}', "", None]
    assert [r["score"] for r in payload.judged(spark.createDataFrame([(i, t) for i, t in enumerate(scores)], "k int, raw string")).orderBy("k").collect()] == [4, 5, None, None, None, None]
