"""Chat: history in batch and as a stream, and answers that know it."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from quarry import catalogue
from quarry.models import Models
from quarry.operators import answers, history
from quarry.plans.engine import Engine
from quarry.streaming import chat
from tests.conftest import SMALL

KIND = "session long, ts timestamp, turn long, role string, text string"


def plain(rows):
    return sorted((r.session, r.turn, r.query, tuple((h.role, h.text) for h in r.history)) for r in rows)


def brute(messages, turns=history.TURNS, idle=history.IDLE):
    out, held = [], {}
    for r in sorted(messages, key=lambda r: (r.ts, r.turn)):
        mine = held.setdefault(r.session, [])
        if mine and (r.ts - mine[-1][0]).total_seconds() > idle:
            mine.clear()
        if r.role == "user":
            out.append((r.session, r.turn, r.text, tuple((a, b) for _, a, b in mine[-turns:])))
        mine.append((r.ts, r.role or "", (r.text or "")[:500]))
    return sorted(out)


def test_stream_and_batch_agree_on_conversations(spark, tmp_path):
    messages = catalogue._messages(spark, SMALL)
    want = brute(messages.collect())
    assert plain(history.with_history(messages).collect()) == want and any(h for *_, h in want)
    src = str(tmp_path / "in")
    for low, high in ((0, 2), (3, 7), (8, 10_000)):  # as the turns come in
        messages.filter(F.col("turn").between(low, high)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    found = []
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = history.history_stream(stream, late="1 day").writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert plain(found) == want


def test_state_goes_with_its_session_and_survives_a_restart(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    src, found = str(tmp_path / "in"), []

    def come(*rows):
        spark.createDataFrame([(s, at(t), n, role, text) for s, t, n, role, text in rows], KIND).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(KIND).parquet(src)
        q = history.history_stream(stream, turns=2, idle=100, late="0 seconds").writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp"))
        q.trigger(availableNow=True).start().awaitTermination()
        out = plain(found)
        found.clear()
        return out

    assert come((1, 0, 0, "user", "a"), (1, 1, 1, "assistant", "b"), (2, 2, 0, "user", None)) == [(1, 0, "a", ()), (2, 0, None, ())]
    assert come((1, 3, 2, "user", "c")) == [(1, 2, "c", (("user", "a"), ("assistant", "b")))]
    assert come((1, 50, 3, None, "d"), (1, 60, 4, "user", "e")) == [(1, 4, "e", (("user", "c"), ("", "d")))]
    assert come((3, 1000, 0, "user", "f")) == [(3, 0, "f", ())]
    assert come((1, 1200, 5, "user", "g"), (2, 1201, 1, "user", "h")) == [(1, 5, "g", ()), (2, 1, "h", ())]


def test_chat_answers_know_what_was_said(spark, tmp_path):
    texts = [(1, 1, "Solar panels turn light into electric current for homes and for grids."), (2, 1, "Bread is baked from flour, water, salt and yeast in a hot oven.")]
    prompts = []

    def say(xs):
        prompts.extend(xs)
        return [f"{x.count('CONVERSATION')} {'user: How is bread baked' in x}" for x in xs]

    e = Engine(spark, str(tmp_path / "store"), Models(generate=say))
    e.ingest(spark.createDataFrame(texts, "doc_id long, page int, text string"))
    rows = [(7, "2024-01-01 00:00:00", 0, "user", "How is bread baked"), (7, "2024-01-01 00:01:00", 1, "assistant", "In an oven."), (7, "2024-01-01 00:02:00", 2, "user", "And with which flour and salt"), (8, "2024-01-01 00:02:00", 0, "user", "solar panels")]
    messages = spark.createDataFrame(rows, "session long, ts string, turn long, role string, text string").withColumn("ts", F.to_timestamp("ts"))
    messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}

    def put(df, number):
        for r in df.collect():
            got[r.session, r.turn] = (r.query, r.answer, [c.page for c in r.citations][:1])

    chat.start(spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in")), e, str(tmp_path / "cp"), put, once=True).awaitTermination()
    assert got == {(7, 0): ("How is bread baked", "0 False", [1]), (7, 2): ("And with which flour and salt", "1 True", [1]), (8, 0): ("solar panels", "0 False", [1])}
    asked = chat.questions(history.with_history(messages))
    batch = {r.query_id: r.answer for r in e.ask(asked.select("query_id", "query", "history")).collect()}
    assert batch == {f"{s}:{t}": a for (s, t), (_, a, _) in got.items()}
    text = spark.range(1).select(answers.prompt(F.lit("q"), F.lit("c"), F.array().cast("array<string>"), F.array().cast(history.HISTORY))).first()[0]
    assert "CONVERSATION" not in text
