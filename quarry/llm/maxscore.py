"""Exact top-k by inner product with MaxScore over impact postings.

A component of an integer vector is a term: (dimension, sign), with the component's size as
weight, so that all weights are positive. A query gives each of the terms a factor; terms of
negative factor can only lower a score, and their bound is 0. Shard by shard, for each query:

* bound of a term: its factor times the largest weight in the shard's postings;
* terms are taken by falling bound; those whose bounds together can't lift a vector to the k-th best
  score so far are non-essential;
* the postings of the essential terms are traversed and their scores added up, for all queries of a
  block at once: long lists, which hold most vectors anyway, as columns of one product, short ones list
  by list; a vector that stands in none of them can't enter;
* the other terms are probed, in steps by falling bound, only for the pairs of query and vector that are
  still competitive, that is, whose score plus the bounds of the terms to come reaches the k-th best;
  while these are more than a few of all pairs, a step is one product, and then pair by pair.

A shard is a chunk of a task's slice; the first is short, so that there soon is a k-th best. The k best
are carried from shard to shard, and the tasks' results merged. Everything is integer arithmetic (in
doubles where the sums stay far below 2^53, else in long integers), so the result is exact.

Defined results: null vectors and those with null or non-finite components take no part; zero vectors do,
with score 0; equal scores go to the smaller vec_id; rows that repeat a vec_id are candidates of their
own, but none of a query of that vec_id, which is answered once, for the smallest vector among its rows;
of vectors of unequal lengths the missing components count as 0; fewer candidates than k give all of
them; an empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import best, same_length, scan, to_batch, usable
from quarry.llm.common import materialize

SCALE = 256
#: Vectors in the first shard of a task; share of a shard from which a posting list is long; steps of probing;
#: share of all pairs up to which pairs are probed one by one.
FIRST, LONG, STEPS, FEW = 256, 0.25, 3, 1 / 64
#: Queries whose scores are in memory at a time.
TURN = 256


class Shard:
    """Postings of some integer vectors: per term (dimension, sign) the rows that hold it and their weights."""

    def __init__(self, x: np.ndarray, kind: type):
        self.x = x.astype(kind)
        self.top = np.maximum(x.max(0, initial=0), 0)
        self.low = np.maximum(-x.min(0, initial=0), 0)
        self.held = (x != 0).sum(0)
        self.long = self.held >= LONG * len(x)
        self.lists = {d: np.flatnonzero(x[:, d]) for d in np.flatnonzero(~self.long & (self.held > 0)).tolist()}

    def search(self, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all pairs whose score may be the query's floor or more. A floor is the
        k-th best score so far, or -inf."""
        # bound of a dimension: of its two terms one has a positive factor
        bounds = np.where(q > 0, q * self.top, -q * self.low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        falling = np.take_along_axis(bounds, order, 1)
        rest = np.cumsum(falling[:, ::-1], 1)[:, ::-1]  # bound of a dimension and all after it
        essential = np.zeros(q.shape, bool)
        # where the floor is 0 or less even a vector without any term of positive factor may enter
        np.put_along_axis(essential, order, (rest >= floor[:, None]) | (floor[:, None] <= 0), 1)
        score = np.where(essential & self.long, q, 0).astype(self.x.dtype) @ self.x.T
        seen = np.zeros(score.shape, bool)
        seen[((essential & self.long & (bounds > 0)).any(1)) | (floor <= 0)] = True
        for d, rows in self.lists.items():
            mine = np.flatnonzero(essential[:, d] & (q[:, d] != 0))
            if len(mine):
                part = q[mine, d][:, None] * self.x[rows, d][None]
                score[np.ix_(mine, rows)] += part.astype(score.dtype)
                seen[np.ix_(mine, rows)] |= part > 0
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(q.shape[1]), q.shape), 1)
        first = essential.sum(1)
        live, pairs = seen, None
        for step in range(STEPS + 1):
            if step:
                # the next share of each query's other terms, those of large bounds first
                ends = first + -(-(q.shape[1] - first) * step // STEPS)
                now = np.where((place >= start[:, None]) & (place < ends[:, None]), q, 0).astype(self.x.dtype)
                if pairs is None:
                    score += now @ self.x.T
                else:
                    at, row, got = pairs
                    for i in range(0, len(at), 1 << 15):
                        piece = slice(i, i + (1 << 15))
                        got[piece] += np.einsum("ij,ij->i", now[at[piece]], self.x[row[piece]])
            start = ends if step else first
            left = np.where(place >= start[:, None], bounds, 0).sum(1)
            if pairs is None:
                live = live & (score >= (floor - left)[:, None])
                if step == STEPS or np.count_nonzero(live) <= FEW * live.size:
                    at, row = np.nonzero(live)
                    pairs = at, row, score[at, row]
            else:
                keep = got >= (floor - left)[at]
                pairs = at[keep], row[keep], got[keep]
        return pairs


class Search:
    """The k best so far of a block of queries."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.rows, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.largest = float(np.abs(queries).sum(1).max(initial=0))

    def floor(self) -> np.ndarray:
        ends = np.searchsorted(self.rows, np.arange(len(self.queries)), "right")
        full = np.bincount(self.rows, minlength=len(self.queries)) >= self.k
        out = np.full(len(self.queries), -np.inf)
        out[full] = self.scores[ends[full] - 1]
        return np.where(np.abs(out) < 2.0**52, out, np.nextafter(out, -np.inf))  # never over the score itself

    def add(self, ids: np.ndarray, x: np.ndarray, _=None) -> None:
        at = FIRST if not len(self.rows) else len(x)
        for a, b in ((0, at), (at, len(x))):
            if a < min(b, len(x)):
                self._shard(ids[a:b], x[a:b])

    def _shard(self, ids: np.ndarray, x: np.ndarray) -> None:
        kind = np.float64 if self.largest * np.abs(x).max(initial=0) < 2.0**52 else np.int64
        shard, floor = Shard(x, kind), self.floor()
        found = [(self.rows, self.ids, self.scores)]
        for t in range(0, len(self.queries), TURN):
            at, row, got = shard.search(self.queries[t : t + TURN].astype(kind), floor[t : t + TURN])
            other = ids[row] != self.query_ids[t + at]
            found.append((t + at[other], ids[row[other]], got[other].astype(np.int64)))
        rows, every, scores = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((every, -scores, rows))
        rows, every, scores = rows[order], every[order], scores[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        self.rows, self.ids, self.scores = rows[keep], every[keep], scores[keep]

    def found(self):
        return to_batch({"query_id": self.query_ids[self.rows], "vec_id": self.ids, "score": self.scores})


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of each query among the other rows, by the
    inner product of floor(scale * component). vectors: vec_id, embedding."""
    v = F.col("embedding")
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(v))
    whole = F.transform(v.cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    rows = same_length(rows.select(F.col("vec_id").cast("long"), whole.alias("embedding")))
    found = scan(materialize(rows), is_query, lambda ids, queries: Search(ids, queries, k), "query_id long, vec_id long, score long")
    out = best(found, k, [F.col("score").desc(), F.col("vec_id")])
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def matches(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
