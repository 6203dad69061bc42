"""Chat: users' messages as a stream, answered in the light of what was said before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import history
from quarry.plans.engine import Engine


def questions(asked: DataFrame) -> DataFrame:
    """Rows of with_history() or history_stream() as queries: query_id is session and turn."""
    return asked.withColumn("query_id", F.concat_ws(":", F.col("session").cast("string"), F.col("turn").cast("string")))


def start(messages: DataFrame, engine: Engine, checkpoint: str, put: Callable[[DataFrame, int], None], turns: int = history.TURNS, idle: int = history.IDLE, once: bool = False):
    """A query that answers the users' messages of a stream (see history). put: gets the answers of a
    micro-batch (session, turn, query, answer, citations, image_references) and its number, which is
    the same when a batch is replayed."""

    def answer(batch: DataFrame, number: int) -> None:
        asked = questions(batch).persist()
        put(asked.select("query_id", "session", "turn", "query").join(engine.ask(asked.drop("session", "turn")), "query_id").drop("query_id"), number)
        asked.unpersist()

    writer = history.history_stream(messages, turns, idle).writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
