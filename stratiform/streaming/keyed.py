"""Keyed state with event-time timers: threads that keep their last turns and expire, and keys that fall silent and return.

Both run on `transformWithState`, which needs the RocksDB state store (`session.build` sets it). What expires does so by event
time: a timer fires once the watermark has passed it, so a replay from a checkpoint, however late, gives the same rows. Times
are microseconds inside the processors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Turns that a thread remembers, and the seconds after which it is forgotten.
REMEMBERED, THREAD_SECONDS = 3, 3600
SILENT_SECONDS = 2 * 3600


class _Timed(StatefulProcessor):
    """A processor with one timer for each key, `gap` microseconds after its last row."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def _timer(self, at: int | None) -> None:
        """Replaces the key's timer by one that fires when the watermark has reached `at`."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))

    def _row(self, key: tuple, at: int, kind: str, **more) -> Row:
        return Row(**{self.key: key[0], "us": at, "kind": kind, **more})

    def close(self) -> None:
        pass


class Threads(_Timed):
    """Per thread the last turns (list state), and their count and time (value state)."""

    def __init__(self, key: str, gap: int, remembered: int):
        super().__init__(key, gap)
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history, self.kept = handle.getListState("history", "user string, assistant string"), handle.getValueState("kept", "turn_count int, last long")

    def _told(self, key: tuple, at: int, kind: str, count: int, turns: list[tuple]) -> Row:
        return self._row(key, at, kind, turn_count=count, history=[Row(user=u, assistant=a) for u, a in turns])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.kept.exists()
        count, last = self.kept.get() if known else (0, None)
        turns = [tuple(t) for t in self.history.get()] if known else []
        for row in sorted(rows, key=lambda r: r["us"]):
            # Expiry is lazy, too: a timer that has not fired yet does not keep a thread alive.
            if last is not None and row["us"] - last > self.gap:
                yield self._told(key, last + self.gap, "expired", count, turns)
                count, turns = 0, []
            count += 1
            yield self._told(key, row["us"], "turn", count, turns)
            turns = [*turns, (row["user"], row["assistant"])][-self.remembered :]
            last = row["us"] if last is None else max(last, row["us"])
        self.history.put(turns)
        self.kept.update((count, last))
        self._timer(last + self.gap + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.kept.exists():
            count, last = self.kept.get()
            yield self._told(key, last + self.gap, "expired", count, [tuple(t) for t in self.history.get()])
            self.kept.clear()
            self.history.clear()


def threads(stream: DataFrame, key: str = "thread_id", remembered: int = REMEMBERED, seconds: int = THREAD_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """(key, ts, kind, turn_count, history) from turns (key, ts, user, assistant).

    A row of kind `turn` for each turn, with its number in the thread and up to `remembered` turns before it; one of kind
    `expired` for each thread without a turn for more than `seconds`, at the time at which that became so. Turns of a batch are
    taken in order of time; one that comes late in a later batch counts as the thread's next.
    """
    turns = stream.select(key, "ts", F.unix_micros("ts").alias("us"), "user", "assistant").where("ts IS NOT NULL").withWatermark("ts", lateness)
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, us long, kind string, turn_count int, history array<struct<user: string, assistant: string>>"
    found = turns.groupBy(key).transformWithState(Threads(key, seconds * 1_000_000, remembered), schema, "Append", "EventTime")
    return found.select(key, F.timestamp_micros("us").alias("ts"), "kind", "turn_count", "history")


def threads_batch(turns: DataFrame, key: str = "thread_id", remembered: int = REMEMBERED, seconds: int = THREAD_SECONDS, tie: str = "ts") -> DataFrame:
    """What `threads` gives, from a table and over all of it: a turn starts anew after a gap of more than `seconds`. Turns of the
    same time stand in the order of `tie`."""
    order = Window.partitionBy(key).orderBy("ts", tie)
    gap = F.col("ts") - F.lag("ts").over(order) > F.expr(f"INTERVAL {seconds} SECONDS")
    marked = turns.where("ts IS NOT NULL").withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own, turn = Window.partitionBy(key, "part").orderBy("ts", tie), F.struct("user", "assistant")
    history = {"history": F.collect_list(turn).over(own.rowsBetween(-remembered, -1)), "final": F.collect_list(turn).over(own.rowsBetween(1 - remembered, 0))}
    rows = marked.withColumns({"turn_count": F.row_number().over(own), "final_turn": F.lead("ts").over(own).isNull(), **history})
    ends = rows.where("final_turn").select(key, (F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("ts"), F.lit("expired").alias("kind"), "turn_count", F.col("final").alias("history"))
    return rows.select(key, "ts", F.lit("turn").alias("kind"), "turn_count", "history").union(ends)


class Silence(_Timed):
    """Per key the time of its last row, and whether it has been called silent since."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "last long, silent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, silent = self.kept.get() if self.kept.exists() else (None, False)
        for at in sorted(row["us"] for row in rows):
            if last is not None and not silent and at - last >= self.gap:
                yield self._row(key, last + self.gap, "silent")
                silent = True
            if silent and at > last:
                yield self._row(key, at, "returned")
                silent = False
            last = at if last is None else max(last, at)
        self.kept.update((last, silent))
        self._timer(None if silent else last + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, silent = self.kept.get()
        if not silent:
            yield self._row(key, last + self.gap, "silent")
            self.kept.update((last, True))


def silences(stream: DataFrame, key: str, seconds: int = SILENT_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """(key, ts, kind) from rows (key, ts): one of kind `silent` once a key has had no row for `seconds`, at the time at which that
    became so, and one of kind `returned` with the next row. A key that never had a row is not known."""
    rows = stream.select(key, "ts", F.unix_micros("ts").alias("us")).where("ts IS NOT NULL").withWatermark("ts", lateness)
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, us long, kind string"
    found = rows.groupBy(key).transformWithState(Silence(key, seconds * 1_000_000), schema, "Append", "EventTime")
    return found.select(key, F.timestamp_micros("us").alias("ts"), "kind")


def silences_batch(rows: DataFrame, key: str, seconds: int = SILENT_SECONDS) -> DataFrame:
    """What `silences` gives, from a table and over all of it, for gaps that have ended."""
    order = Window.partitionBy(key).orderBy("ts")
    gaps = rows.where("ts IS NOT NULL").withColumn("last", F.lag("ts").over(order)).where(F.col("ts") - F.col("last") >= F.expr(f"INTERVAL {seconds} SECONDS"))
    both = F.array(F.struct((F.col("last") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("ts"), F.lit("silent").alias("kind")), F.struct("ts", F.lit("returned").alias("kind")))
    return gaps.select(key, F.explode(both).alias("row")).select(key, "row.ts", "row.kind")
