"""Keyed state against a batch computation, with a restart from the checkpoint between batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stratiform.streaming import keyed

START = datetime(2024, 1, 1)


def _at(minutes):
    return START + timedelta(minutes=minutes)


def _run(spark, tmp_path, batches, schema, make):
    """The rows of a query that is started again for each batch, from its checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/part={i:03d}")
        stream = spark.readStream.schema(f"{schema}, part int").parquet(source)
        run = make(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination(240)
        assert run.exception() is None
    return spark.read.parquet(out)


def test_threads_equal_the_batch(spark, tmp_path):
    rng, turns, now = random.Random(3), [], {k: 0.0 for k in range(4)}
    for i in range(60):
        k = rng.randrange(4)
        now[k] = max(now[k], i * 12) + rng.choice([1, 5, 20, 60, 61, 300])
        turns.append((k, _at(now[k]), f"u{i}", f"a{i}"))
    turns.sort(key=lambda t: t[1])
    turns += [(0, turns[-1][1] + timedelta(minutes=1), "u", None), (0, turns[-1][1] + timedelta(minutes=61), None, "a")]
    schema = "thread_id long, ts timestamp, user string, assistant string"
    batches = [turns[:25], turns[25:60], turns[60:], [(9, turns[-1][1] + timedelta(days=1), "last", "")]]
    got = _run(spark, tmp_path, batches, schema, keyed.threads)
    want = keyed.threads_batch(spark.createDataFrame(turns, schema))
    plain = lambda df: sorted((r["thread_id"], r["ts"], r["kind"], r["turn_count"], [tuple(h) for h in r["history"]]) for r in df.where("thread_id <> 9").collect())
    assert plain(got) == plain(want) and got.where("kind = 'expired'").count() > 5 and got.agg(F.max(F.size("history"))).first()[0] == 3


def test_exactly_the_time_to_live_keeps_a_thread(spark):
    rows = [(1, _at(0), "a", "b"), (1, _at(60), "c", "d"), (1, _at(121), "e", "f")]
    got = keyed.threads_batch(spark.createDataFrame(rows, "thread_id long, ts timestamp, user string, assistant string")).where("kind = 'turn'").orderBy("ts").collect()
    assert [(r["turn_count"], len(r["history"])) for r in got] == [(1, 0), (2, 1), (1, 0)]


def test_silent_keys_are_told_once_and_when_they_return(spark, tmp_path):
    batches = [
        [("a", _at(0)), ("b", _at(0)), ("b", _at(100))],
        [("b", _at(150)), ("c", _at(150))],  # a has been silent since 120, which the watermark of 140 has passed
        [("b", _at(160)), ("c", _at(400))],  # c was silent from 270 to 400, b is from 280
        [("a", _at(410)), ("b", _at(420)), ("a", None)],
        [("d", _at(500))],
    ]
    got = _run(spark, tmp_path, batches, "place string, ts timestamp", lambda s: keyed.silences(s, "place"))
    rows = sorted((r["place"], int((r["ts"] - START).total_seconds() / 60), r["kind"]) for r in got.collect())
    assert rows == [("a", 120, "silent"), ("a", 410, "returned"), ("b", 280, "silent"), ("b", 420, "returned"), ("c", 270, "silent"), ("c", 400, "returned")]
