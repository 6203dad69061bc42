"""Whitening of embeddings with a covariance that is computed in tiles.

The dimensions are cut into tiles, and each two tiles (i <= j) are a tile key. Tasks cut their rows into
row-blocks and each row-block, centred, into column blocks, one a tile. The column blocks are shuffled by
row-block, where each meets those of its own and later tiles; their products are added up per tile key within
a task, and the tasks' sums are shuffled by tile key and added, in two steps, so that no task reads all.
The tiles (d * d numbers for d dimensions, however many the rows) are put together on the driver, and the
eigenvectors of the largest eigenvalues, over the roots of these, whiten the rows.

Components are whole numbers x = floor(64 * c) + 1000000, so that counts and sums are exact; the covariance
is that of the distinct x vectors, each taken once. Of the whitened values the same tiled covariance is taken
once more and compared with the identity.

Defined results: vectors that are null or hold null or non-finite entries take no part; shorter vectors, the
empty one included, are padded with c = 0; rows that repeat a vec_id or a vector are rows of their own, and a
null vec_id stays null; directions whose eigenvalue is not over 1e-12 of the largest have no variance to
divide by and are no components, so that one distinct vector alone, and an empty table, give an empty table.
Each component's sign makes its entry of largest size positive. Sums over the range of long raise an error.
Extra columns are not read. The session's batches for Python workers are bounded (common.bounded_batches).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import matrix, same_length
from quarry.llm.common import bounded_batches, materialize

#: Fixed values of the contract.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Dimensions of a tile at least, tiles at most, numbers in a row-block, and parts in which a tile's sums are added first.
NARROW, TILES, BLOCK, PARTS = 16, 16, 1 << 20, 16
#: Share of the largest eigenvalue that a component's has to exceed.
LEAST = 1e-12


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows of vectors (vec_id, embedding) that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.filter(v.isNotNull() & fine).select("vec_id", v.cast("array<double>").alias("embedding"))
    return same_length(rows).select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))


def _sums(rows: DataFrame, kind: str) -> tuple[int, list]:
    """How many rows of x there are, and the sum of each dimension; kind: long or double."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                if kind == "long" and x.size and max(-int(x.min()), int(x.max())) * batch.num_rows >= 1 << 62:
                    raise OverflowError("sums of vector components leave the range of long")
                part = x.sum(0)
                n, total = n + batch.num_rows, part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["at", "total", "n"])

    found = rows.select("x").mapInArrow(add, f"at long, total {kind}, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    by = sorted(found.collect())  # a row a dimension
    return (by[0]["n"], [r["total"] for r in by]) if by else (0, [])


def covariance(rows: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """Covariance, with divisor n, of n rows of x (arrays of one length), centred at mean."""
    bounded_batches(rows.sparkSession)
    d = len(mean)
    width = max(NARROW, -(-d // TILES))
    tiles = -(-d // width)
    tall = max(1, BLOCK // d)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, tall):
                part = batch.slice(at, tall)
                x = matrix(part.column(0), part.num_rows) - mean
                blocks = [np.ascontiguousarray(x[:, t * width : (t + 1) * width]).tobytes() for t in range(tiles)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(tiles, task + count)), pa.array(range(tiles), pa.int32()), pa.array(np.full(tiles, part.num_rows)), pa.array(blocks, pa.binary())], ["block", "tile", "height", "x"])
                count += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, height, a, b in zip(*(batch.column(k) for k in range(5)), strict=True):
                left, right = (np.frombuffer(v.as_py(), np.float64).reshape(height.as_py(), -1) for v in (a, b))
                key = i.as_py(), j.as_py()
                sums[key] = left.T @ right + sums.get(key, 0.0)
        yield from _tiles(sums, TaskContext.get().partitionId() % PARTS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i, j, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (i, j) != key:
                    if key is not None:
                        yield from _tiles({key: total}, 0)
                    key, total = (i, j), 0.0
                total = total + np.frombuffer(x.as_py(), np.float64)
        if key is not None:
            yield from _tiles({key: total}, 0)

    blocks = rows.select("x").mapInArrow(cut, "block long, tile int, height long, x binary")
    left = blocks.select("block", F.col("tile").alias("i"), "height", F.col("x").alias("a"))
    right = blocks.select("block", F.col("tile").alias("j"), F.col("x").alias("b"))
    pairs = left.join(right.hint("merge"), "block").filter("i <= j").select("i", "j", "height", "a", "b")
    kind = "i int, j int, part int, x binary"
    sums = pairs.mapInArrow(multiply, kind)
    for keys in (("i", "j", "part"), ("i", "j")):
        sums = sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(gather, kind)
    out = np.zeros((d, d))
    for i, j, _, x in sums.collect():  # tiles * (tiles + 1) / 2 of them
        a, b = slice(i * width, min(d, (i + 1) * width)), slice(j * width, min(d, (j + 1) * width))
        out[a, b] = np.frombuffer(x, np.float64).reshape(a.stop - a.start, -1) / n
        out[b, a] = out[a, b].T
    return out


def _tiles(sums: dict[tuple[int, int], np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    for (i, j), x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["i", "j", "part", "x"])


@dataclass
class Whitening:
    """What a fit list gives: its size, the sums of its dimensions, the eigenvectors (columns), their
    eigenvalues, the trace of the covariance, and how far the whitened fit list's covariance is from the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x."""
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n * x - S)^2, exact."""
        low, high = x.min(0).tolist(), x.max(0).tolist()
        far = [max(abs(self.n * a - s), abs(self.n * b - s)) for a, b, s in zip(low, high, self.sums, strict=True)]
        if sum(f * f for f in far) >= 1 << 63 or any(self.n * max(-a, b) >= 1 << 63 for a, b in zip(low, high, strict=True)):
            raise OverflowError("deviations leave the range of long")
        off = self.n * x - np.array(self.sums, np.int64)
        return (off * off).sum(1)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (x array<long>, all of one length), each distinct x once; None where nothing varies."""
    listed = materialize(rows.select("x").distinct())
    n, sums = _sums(listed, "long")
    if not sums:
        return None
    v = covariance(listed, n, np.array([s / n for s in sums]))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > max(LEAST * values[0], 0.0)
    values, vectors = values[keep], vectors[:, keep]
    if not len(values):
        return None
    top = vectors[np.abs(vectors).argmax(0), np.arange(len(values))]
    out = Whitening(n, sums, vectors * np.where(top < 0, -1.0, 1.0), values, float(np.trace(v)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([_lists(out.project(matrix(batch.column(0), batch.num_rows)))], ["x"])

    white = listed.mapInArrow(project, "x array<double>")
    mean = np.array(_sums(white, "double")[1]) / n
    out.identity_error = float(np.abs(covariance(white, n, mean) - np.eye(len(values))).max())
    return out


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def whiten(rows: DataFrame, how: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of rows (vec_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(how.deviations(x)), _lists(how.project(x))], ["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def components(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each row of vectors (vec_id, embedding) and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    rows = whole_vectors(vectors)
    bounded_batches(vectors.sparkSession)
    how = fit(rows, most)
    if how is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(e / how.trace)) for e in how.values])
    out = whiten(rows, how).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(how.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(how.identity_error).alias("identity_error"),
    )
