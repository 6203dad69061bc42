"""Tasks of query blocks against slices of vectors, and candidate merging, for the two vector searches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block and vectors in a slice: a task holds one block, and reads the vectors as a stream.
QUERY_BLOCK, SLICE = 4096, 8192
#: Vectors that are scored at a time, whatever the batches they come in.
CHUNK = 8192


def usable(vector: Column) -> Column:
    """Whether a vector is not null or empty and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def same_length(rows: DataFrame) -> DataFrame:
    """rows with embedding padded with zeros to the length of the longest."""
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    short = F.lit(longest) - F.size("embedding")
    return rows.withColumn("embedding", F.when(short > 0, F.concat("embedding", F.array_repeat(F.lit(0.0), short))).otherwise(F.col("embedding")))


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """A column of n lists of one length as an n-row matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """The parts of a batch that agree in block, slice and kind, its first three columns."""
    keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def scan(rows: DataFrame, is_query, make: Callable, schema: str) -> DataFrame:
    """Every block of queries against every slice of vectors, each pair in one task of one job.

    rows: vec_id, embedding and more columns; is_query: a condition on vec_id. Rows that repeat a vec_id are
    one query, by the smallest of their vectors, and vectors each. make(ids, queries) gives a search with add(ids, vectors, batch of the more columns) and found(), which gives a record batch of
    schema. Queries go along with each slice and vectors with each block: what is moved is the product of
    the two, as is the work, and nothing passes through the driver but two counts.
    """
    more = [c for c in rows.columns if c not in ("vec_id", "embedding")]
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks, slices = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-rows.count() // SLICE))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    queries = queries.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in more], every(slices).alias("slice"))
    queries = queries.withColumns({"block": own("vec_id", blocks), "kind": F.lit(0)})
    place = F.monotonically_increasing_id()  # so that not even rows of one vec_id fall together
    vectors = rows.withColumn("place", place).withColumn("block", every(blocks)).withColumns({"slice": own("place", slices), "kind": F.lit(1)})
    both = [x.select("block", "slice", "kind", "vec_id", "embedding", *more) for x in (queries, vectors)]
    met = both[0].unionByName(both[1]).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind")

    def run(batches):
        task, asked, search, held = None, [], None, []

        def score():
            if held:
                some = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=CHUNK)
                held.clear()
                for part in some:
                    search.add(part.column(3).to_numpy(zero_copy_only=False), matrix(part.column(4), part.num_rows), part)

        for batch in batches:
            for (b, s, kind), part in _runs(batch):
                if (b, s) != task:
                    if search is not None:
                        score()
                        yield search.found()
                    task, asked, search = (b, s), [], None
                if kind == 0:
                    asked.append((part.column(3).to_numpy(zero_copy_only=False), matrix(part.column(4), part.num_rows)))
                    continue
                if search is None and asked:
                    search = make(*(np.concatenate(x) for x in zip(*asked, strict=True)))
                if search is not None:
                    held.append(part)
                    if sum(x.num_rows for x in held) >= CHUNK:
                        score()
        if search is not None:
            score()
            yield search.found()

    return met.mapInArrow(run, schema)


def to_batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each query_id, with their rank."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)
