"""Connected components of an edge table: contraction within partitions, then star contractions between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_hot, materialize, release_since, scratch_mark

#: Edges that a task holds at a time; so many in all, or fewer, are joined in one task.
HELD = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and of each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        if (low == high).all():
            return nodes, nodes[up]
        np.minimum.at(up, high, low)
        while not (up[up] == up).all():
            up = up[up]


def _contract(batches):
    """Edges from each node to the smallest that is joined to it within HELD edges of a partition."""
    a, b, n = [], [], 0

    def star():
        nodes, low = roots(np.concatenate(a), np.concatenate(b))
        far = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(low[far])], ["a", "b"])

    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            part = batch.slice(at, HELD)
            a.append(part.column(0).to_numpy(zero_copy_only=False))
            b.append(part.column(1).to_numpy(zero_copy_only=False))
            n += part.num_rows
            if n >= HELD:
                yield star()
                a, b, n = [], [], 0
    if n:
        yield star()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Each partition contracts its own edges to stars first, which leaves no more edges than it has nodes.
    If HELD or fewer are left in all, one task joins them. Else each round links every node's larger
    neighbours, then all its smaller ones, to the smallest node it knows; the number of rounds grows with
    the logarithm of the longest path. Aggregates before it shuffles; the many edges of a star's centre
    stay where they are and its smallest neighbour is broadcast. Every round is written to the shared
    folder, and the one before it removed.
    """
    spark, mark = edges.sparkSession, scratch_mark()
    pairs = materialize(edges.filter("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long"))
    if pairs.count() < HELD:
        pairs = materialize(pairs.coalesce(1).mapInArrow(_contract, "a long, b long"))
        release_since(spark, mark, keep=1)
        return _nodes(pairs)
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        least = least.filter("n > 0").select("a", F.least("a", "low").alias("low"), "n")
        large = materialize(join_hot(both.filter("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, least, ["a"], "n").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        pairs = materialize(small.filter("a <> b").distinct())
        release_since(spark, mark, keep=1)
        # a star forest has one edge for each node that isn't a root, and then nothing changes
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _nodes(pairs)


def _nodes(pairs: DataFrame) -> DataFrame:
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
