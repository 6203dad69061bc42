"""What was said before in a conversation: the last turns of each session, in batch and in streams.

messages: session, ts (timestamp), turn (long), role, text. A session whose next message comes later than
`idle` seconds after the one before begins anew. with_history() and history_stream() give the same rows for the
same messages, if a stream brings those of a session in order (within a micro-batch they are put in order).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Turns that are remembered, characters of each, and seconds without a message after which a session is over.
TURNS, SHOWN, IDLE = 6, 500, 3600
HISTORY = "array<struct<role: string, text: string>>"


def with_history(messages: DataFrame, turns: int = TURNS, idle: int = IDLE) -> DataFrame:
    """(session, turn, query, history) of the users' messages: up to `turns` messages before each, oldest first."""
    order = ("ts", "turn")
    own = Window.partitionBy("session").orderBy(*order)
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(own))
    rows = messages.withColumn("part", F.sum(F.when(gap > idle * 1_000_000, 1).otherwise(0)).over(own))
    before = Window.partitionBy("session", "part").orderBy(*order).rowsBetween(-turns, -1)
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.substring(F.coalesce("text", F.lit("")), 1, SHOWN).alias("text"))
    rows = rows.withColumn("history", F.collect_list(said).over(before).cast(HISTORY))
    return rows.filter("role = 'user'").select("session", "turn", F.col("text").alias("query"), "history")


class Remember(StatefulProcessor):
    """The state of a session: its last messages. A timer lets it go when the session is over."""

    def __init__(self, turns: int, idle: int):
        self.turns, self.idle = turns, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", StructType([StructField("ts", LongType()), StructField("role", StringType()), StructField("text", StringType())]))
        self.timer = handle.getValueState("timer", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        for ts, turn, role, text in sorted(((r.micros, r.turn, r.role, r.text) for r in rows), key=lambda r: r[:2]):
            if held and ts - held[-1][0] > self.idle * 1_000_000:
                held = []
            if role == "user":
                yield Row(session=key[0], turn=turn, query=text, history=[Row(role=a, text=b) for _, a, b in held])
            held = [*held, (ts, role or "", (text or "")[:SHOWN])][-self.turns :]
        if held:
            self.last.put(held)
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = held[-1][0] // 1000 + self.idle * 1000 + 1
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.last.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def history_stream(messages: DataFrame, turns: int = TURNS, idle: int = IDLE, late: str = "10 minutes") -> DataFrame:
    """with_history() of a stream of messages. late: how much later than the newest a message may come.
    Sets the session's state store to RocksDB, which this needs."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = messages.schema["session"].dataType.simpleString()
    rows = messages.withWatermark("ts", late).select("session", "ts", F.unix_micros("ts").alias("micros"), "turn", "role", "text")
    return rows.groupBy("session").transformWithState(Remember(turns, idle), StructType.fromDDL(f"session {kind}, turn long, query string, history {HISTORY}"), "Append", "EventTime")


def told(history: Column) -> Column:
    """History as lines of a prompt."""
    return F.array_join(F.transform(history, lambda h: F.concat(h["role"], F.lit(": "), h["text"])), "\n")
