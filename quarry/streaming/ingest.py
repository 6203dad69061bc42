"""Continuous ingestion: micro-batches upserted into the store, each exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.store import Store
from quarry.plans.engine import Engine
from quarry.sources import binary


def document_stream(spark: SparkSession, path: str, schema, per_batch: int = 10) -> DataFrame:
    """Parquet files that arrive below path, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def file_stream(spark: SparkSession, path: str, pattern: str = "*.pdf", per_batch: int = 100) -> DataFrame:
    """Binary files that arrive below path, as a stream: path, modificationTime, length and content."""
    schema = spark.read.format("binaryFile").load(path).schema
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return rows.option("maxFilesPerTrigger", per_batch).load(path)


def _run(stream: DataFrame, put: Callable, checkpoint: str, once: bool):
    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start(stream: DataFrame, store: Store, name: str, key: list[str], checkpoint: str, transform=None, once: bool = False):
    """A query that upserts each micro-batch. A version of the table carries the number of the batch that
    made it, so a batch that is replayed is left out, even if others have written since."""

    def put(batch: DataFrame, number: int) -> None:
        store.add(name, transform(batch) if transform else batch, key, tag=(checkpoint, number))

    return _run(stream, put, checkpoint, once)


def start_files(stream: DataFrame, engine: Engine, checkpoint: str, decoder: Callable = binary.plain_document, extensions: tuple[str, ...] | None = None, once: bool = False, told: Callable[[DataFrame, int], None] | None = None):
    """A query that decodes and ingests each micro-batch of file_stream(). Text and images are versions of two
    tables with the number of the batch; what of a batch is there already when it is replayed stays as it is.
    told: gets the status of the files of a batch, and its number."""

    def put(batch: DataFrame, number: int) -> None:
        out = engine.ingest_binary(batch, decoder, extensions, again=True, tag=(checkpoint, number))
        if told is not None:
            told(out, number)

    return _run(stream, put, checkpoint, once)
