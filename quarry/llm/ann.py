"""Nearest neighbours with score-aware (anisotropic) product quantisation.

A vector x is held as four-bit codes, one for each DIMS dimensions. The codebooks minimise not the
plain quantisation error but one in which the part of the error that is parallel to x costs more
than the orthogonal part, since the parallel part moves large inner products most. Nearness by
Euclidean distance is maximum inner product of (2x, -|x|^2) with (q, 1); the norm is kept as it
is, and the codes stand for x.

The index is a table that is written once: vectors, codes of two to a byte, the length of what the
codes leave of x, and that of what they stand for. A task searches a slice of it for a block of
queries: for every query it adds the 16-entry table values of the codes. A guess is off by at most |q|
times the length of what the codes leave of x, so each vector has a score that it can't exceed. The
`rerank` best guesses of a chunk are scored exactly, and then every other vector that can still come
under the k-th distance so far, however many they are. A task thus gives its k nearest for certain, and
the nearest of all tasks are the nearest of all.

The index is fitted on a bounded sample (at most `sample` vectors, by a digest of vec_id); every
vector is encoded. The fit decides how many vectors are scored exactly, not what is found.

Defined results: null, empty, zero and non-finite vectors take no part; equal distances go to the smaller
vec_id, so copies of one vector are found in the order of their ids; rows that repeat a vec_id are
candidates of their own, but none of a query of that vec_id, which is answered once, for one of its rows
(the smallest vector); vectors are padded with zeros to the longest; fewer candidates than k give all of
them; an empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import best, matrix, same_length, scan, to_batch, usable
from quarry.llm.common import materialize

CENTRES = 16
DIMS = 1
SAMPLE = 8192
#: Guesses of a chunk that are scored exactly before the others are judged.
RERANK = 64
#: Queries whose guesses are in memory at a time, vectors that are encoded at a time, and vectors whose
#: table values are added up at a time.
TURN, ENCODED, NEAR = 256, 1024, 128
#: A query with more than this share of a chunk left to score gets one product with the whole chunk first.
MANY = 1 / 16
#: Inner products from this share of |x| |q| up are the ones that the weighting is for.
THRESHOLD = 0.2


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """Cost of parallel over orthogonal error: (d - 1) T^2 / (1 - T^2), at least 1."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


@dataclass
class Quantiser:
    """books: (parts, CENTRES, DIMS) centres; weight: cost of parallel error."""

    books: np.ndarray
    weight: float

    def _split(self, x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % DIMS
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, DIMS)

    def encode(self, x: np.ndarray, sweeps: int = 1) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic error, from the nearest centres."""
        parts = self._split(x)
        unit = parts / np.maximum(np.sqrt((x * x).sum(1)), 1e-30)[:, None, None]
        far = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(3)
        along = (unit * parts).sum(2)[:, :, None] - np.einsum("npd,pcd->npc", unit, self.books)
        codes = far.argmin(2)
        error = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
        total = error.sum(1)
        for _ in range(sweeps):
            for p in range(parts.shape[1]):
                rest = total - error[:, p]
                cost = far[:, p] + (self.weight - 1) * (rest[:, None] + along[:, p]) ** 2
                codes[:, p] = cost.argmin(1)
                error[:, p] = np.take_along_axis(along[:, p], codes[:, p, None], 1)[:, 0]
                total = rest + error[:, p]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, with the padding of the parts."""
        return np.take_along_axis(self.books[None], codes[:, :, None, None].astype(int), 2).reshape(len(codes), -1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts, CENTRES) inner products of the queries' parts with the centres."""
        return np.einsum("npd,pcd->npc", self._split(queries), self.books)


def fit(x: np.ndarray, rounds: int = 8, seed: int = 3) -> Quantiser:
    """Codebooks for the rows of x: alternate encoding and weighted least squares."""
    rng = np.random.default_rng(seed)
    model = Quantiser(np.zeros((-(-x.shape[1] // DIMS), CENTRES, DIMS)), parallel_weight(x.shape[1]))
    parts = model._split(x)
    picks = rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)
    model.books = parts[picks].transpose(1, 0, 2).copy()
    unit = parts / np.maximum(np.sqrt((x * x).sum(1)), 1e-30)[:, None, None]
    for turn in range(rounds):
        codes = model.encode(x, sweeps=min(turn, 1))
        fit_parts = np.take_along_axis(model.books[None], codes[:, :, None, None].astype(int), 2)[:, :, 0]
        gap = (unit * (parts - fit_parts)).sum(2)
        total = gap.sum(1)
        for p in range(parts.shape[1]):
            # a centre c minimises sum |x_p - c|^2 + (w - 1) (rest + u_p . (x_p - c))^2
            rest = total - gap[:, p]
            for c in range(CENTRES):
                mine = codes[:, p] == c
                if not mine.any():
                    model.books[p, c] = parts[rng.integers(len(x)), p]
                    continue
                u, v = unit[mine, p], parts[mine, p]
                a = np.eye(DIMS) * mine.sum() + (model.weight - 1) * u.T @ u
                b = v.sum(0) + (model.weight - 1) * (u * (rest[mine] + (u * v).sum(1))[:, None]).sum(0)
                model.books[p, c] = np.linalg.solve(a, b)
            fresh = model.books[p][codes[:, p]]
            gap[:, p] = (unit[:, p] * (parts[:, p] - fresh)).sum(1)
            total = rest + gap[:, p]
    return model


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles, padded with zeros to one length) of the vectors that take part."""
    v = F.col("embedding")
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(v)).select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("embedding"))
    return same_length(rows.filter(F.exists("embedding", lambda x: x != 0)))


def train(rows: DataFrame, sample: int = SAMPLE) -> Quantiser | None:
    """A quantiser fitted on at most `sample` of the usable vectors."""
    n = rows.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64(F.lit(11), F.col("vec_id")), F.lit(1 << 30)) / (1 << 30)
    picked = rows.filter(place < min(1.0, sample / n)).limit(2 * sample).toPandas().sort_values("vec_id")
    if not len(picked):
        picked = rows.limit(sample).toPandas()
    return fit(np.stack(picked["embedding"].to_numpy()))


def distances(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, summed in the order of the dimensions so that copies have equal ones."""
    total = np.zeros(len(x))
    for p in range(x.shape[1]):
        total += (x[:, p] - queries[:, p]) ** 2
    return np.sqrt(total)


def k_best(rows: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int):
    """Of each row, the k smallest distances, ties to smaller ids; sorted by row."""
    order = np.lexsort((ids, far, rows))
    rows, ids, far = rows[order], ids[order], far[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], far[keep]


class Turn:
    """The k nearest so far of a few queries; rows, ids and far are those of the queries, by row."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
        self.query_ids, self.queries, self.k, self.rerank = query_ids, queries, k, max(rerank, k)
        self.squares = (queries * queries).sum(1)
        self.rows, self.ids, self.far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def floor(self) -> np.ndarray:
        """The least <q, x> - |x|^2 / 2 that can come under the k-th distance, or tie with it, less rounding."""
        ends = np.searchsorted(self.rows, np.arange(len(self.queries)), "right")
        full = np.bincount(self.rows, minlength=len(self.queries)) >= self.k
        worst = np.full(len(self.queries), np.inf)
        worst[full] = self.far[ends[full] - 1] ** 2
        slip = 8 * (self.queries.shape[1] + 8) * 2.0**-53
        return (self.squares - worst) / 2 - slip * (self.squares + worst)

    def score(self, ids: np.ndarray, x: np.ndarray, chosen: np.ndarray):
        """Exact distances of the chosen (queries x vectors), block by block, into the best."""
        rows, at = np.nonzero(chosen)
        for i in range(0, len(rows), 1 << 16):
            r, c = rows[i : i + (1 << 16)], at[i : i + (1 << 16)]
            found = np.concatenate([self.rows, r]), np.concatenate([self.ids, ids[c]]), np.concatenate([self.far, distances(x[c], self.queries[r])])
            self.rows, self.ids, self.far = k_best(*found, self.k)

    def add(self, ids: np.ndarray, x: np.ndarray, guess: np.ndarray, left: np.ndarray, size: np.ndarray):
        """Vectors with their guesses (queries x vectors), |x - decoded| and |decoded|."""
        half, norm = (x * x).sum(1) / 2, np.sqrt(self.squares)[:, None]
        other = ids[None] != self.query_ids[:, None]
        # what the codes leave out, and the rounding of the single-precision sums
        reach = guess + norm * (left * (1 + 1e-6)) + (guess.dtype.type(2) ** -23 * (x.shape[1] + 8)) * (norm * size + half)
        open_ = other & ~(reach < self.floor()[:, None])
        if len(ids) > self.rerank:
            first = np.zeros_like(open_)
            guess = np.where(other, guess, -np.inf)
            np.put_along_axis(first, np.argpartition(-guess, self.rerank - 1, axis=1)[:, : self.rerank], True, 1)
            self.score(ids, x, first & open_)
            open_ &= ~first & ~(reach < self.floor()[:, None])
        many = open_.sum(1) > max(MANY * len(ids), self.k)
        if many.any():
            # products in double precision; those that surely have k better ones go
            close = np.where(open_[many], self.queries[many] @ x.T - half, -np.inf)
            slip = 8 * (x.shape[1] + 8) * 2.0**-53 * (self.squares[many, None] + 2 * half)
            edge = -np.partition(-(close - slip), self.k - 1, axis=1)[:, self.k - 1]
            open_[many] &= ~(close + slip < np.maximum(edge, self.floor()[many])[:, None])
        self.score(ids, x, open_)


def index(rows: DataFrame, model: Quantiser) -> DataFrame:
    """rows (vec_id, embedding) with codes, left and size, encoded once and written to the shared folder."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED):
                part = batch.slice(at, ENCODED)
                x = matrix(part.column(1), part.num_rows)
                codes = model.encode(x)
                decoded = model.decode(codes)
                left = np.sqrt(((np.pad(x, ((0, 0), (0, decoded.shape[1] - x.shape[1]))) - decoded) ** 2).sum(1))
                packed = [c.tobytes() for c in pack(codes)]
                arrays = [part.column(0), part.column(1), pa.array(packed, pa.binary()), pa.array(left), pa.array(np.sqrt((decoded * decoded).sum(1)))]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "embedding", "codes", "left", "size"])

    return materialize(rows.mapInArrow(run, "vec_id long, embedding array<double>, codes binary, left double, size double"))


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack(packed: pa.Array, parts: int) -> np.ndarray:
    both = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    return np.stack([both & 15, both >> 4], 2).reshape(len(both), -1)[:, :parts]


class Search:
    """A block of queries against the vectors of the index that are added."""

    def __init__(self, model: Quantiser, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
        tables = model.tables(queries).astype(np.float32)
        self.parts = tables.shape[1]
        starts = range(0, len(queries), TURN)
        self.tables = [np.ascontiguousarray(tables[at : at + TURN].transpose(1, 2, 0)) for at in starts]
        self.turns = [Turn(query_ids[at : at + TURN], queries[at : at + TURN], k, rerank) for at in starts]

    def add(self, ids: np.ndarray, x: np.ndarray, rows: pa.RecordBatch) -> None:
        codes = unpack(rows.column("codes"), self.parts)
        left, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("left", "size"))
        columns = np.ascontiguousarray(codes.T).astype(np.intp)
        half = ((x * x).sum(1) / 2).astype(np.float32)
        for table, turn in zip(self.tables, self.turns, strict=True):
            total = np.repeat(-half[:, None], len(turn.queries), axis=1)
            held = np.empty((NEAR, len(turn.queries)), np.float32)
            for a in range(0, len(x), NEAR):  # so few vectors that their sums stay in the cache
                some = total[a : a + NEAR]
                for p in range(self.parts):
                    some += np.take(table[p], columns[p, a : a + NEAR], axis=0, out=held[: len(some)], mode="clip")
            turn.add(ids, x, np.ascontiguousarray(total.T), left, size)

    def found(self) -> pa.RecordBatch:
        parts = [(t.query_ids[t.rows], t.ids, t.far) for t in self.turns]
        return to_batch(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def nearest(vectors: DataFrame, is_query, k: int = 10, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query among the other rows.

    vectors: vec_id, embedding. is_query: a condition on vec_id. score: Euclidean distance.
    """
    rows = usable_vectors(vectors)
    model = train(rows, sample)
    if model is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    found = scan(index(rows, model), is_query, lambda ids, queries: Search(model, ids, queries, k, rerank), "query_id long, vec_id long, score double")
    out = best(found, k, [F.col("score"), F.col("vec_id")])
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 100 == 0)
