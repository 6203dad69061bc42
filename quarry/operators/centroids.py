"""A stored index of vectors for exact search by cosine that skips whole partitions.

Vectors, scaled to length 1, are dealt to the nearest of some centroids and stored by centroid, each with its
distance from it. A partition's radius is the largest of these. By the triangle inequality no vector of a
partition is nearer to a query than the centroid's distance less the radius, and no single vector nearer
than the difference of the two distances; and a distance d between unit vectors is a cosine of 1 - d*d/2. A
search

1. scores the few partitions whose centroids are nearest; the k-th best cosine is a threshold;
2. reads the partitions that can reach it (partition pruning), and scores those of their vectors that can.

The result is that of dense.search(). Vectors without a direction (null, zero, not finite) are a partition
of cosine 0, vectors of another length than the centroids one that is always read. Like the postings, vectors
follow the documents by segments and ids that are gone; the centroids stay until the index is made anew,
which is due once it has grown GROWTH-fold. Centroids are fitted on a bounded sample and are few; only
these and a number per partition reach the driver.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine, norm, normalise
from quarry.operators.common import broadcast_if_small, ranked
from quarry.operators.store import Conflict, Versions

#: Vectors in a partition on average and centroids at most; vectors that the centroids are fitted on, for each of them.
PARTITION_ROWS, MOST_CENTROIDS, SAMPLE_EACH = 1 << 14, 4096, 64
#: Vectors in a file on average; partitions that a search scores for its threshold; growth after which centroids are due.
FILE_ROWS, SEEDS, GROWTH = 1 << 17, 2, 4
ROUNDS, SEED = 8, 5
#: Partitions of vectors that have no centroid.
FLAT, ODD = -1, -2
_SLACK = 1e-6


def fit(rows: DataFrame, count: int, seed: int = SEED) -> np.ndarray:
    """Centroids of at most SAMPLE_EACH * count unit vectors (x array<double>), chosen by a digest of them."""
    place = F.xxhash64(F.lit(seed), F.col("x"))
    sample = np.array([r[0] for r in rows.select("x", place.alias("place")).orderBy("place").limit(SAMPLE_EACH * count).select("x").collect()])
    sample = np.unique(sample, axis=0) if len(sample) else np.zeros((0, 1))
    rng = np.random.default_rng(seed)
    at = sample[rng.permutation(len(sample))[:count]]
    for _ in range(ROUNDS):
        near = (sample @ at.T - 0.5 * (at * at).sum(1)).argmax(1)
        for c in np.unique(near):
            at[c] = sample[near == c].mean(0)
    return at


class Centroids:
    """An index of vectors (id, embedding) below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/versions")
        self._pinned: dict | None = None
        self._kept: list[DataFrame] = []

    def state(self) -> dict:
        """segments, the type of ids, the folder of the centroids, and what the last update was made from."""
        if self._pinned is not None:
            return self._pinned
        number = self.versions.newest()
        return self.versions.read(number) | {"version": number} if number else {"version": 0, "segments": [], "id": "long", "centroids": None, "fitted": 0, "source": None}

    def pin(self) -> Centroids:
        self._pinned = self.state()
        return self

    def _centroids(self, state: dict) -> np.ndarray:
        rows = self.spark.read.schema("centroid int, x array<double>").parquet(f"{self.path}/centroids/{state['centroids']}").orderBy("centroid").collect()
        return np.array([r["x"] for r in rows])

    # ---- updates

    def update(self, new: DataFrame | None, gone: DataFrame | None = None, source=None, whole: bool = False) -> dict:
        """Take in new rows (id, embedding) and take out ids that are gone. With `whole` the index starts anew,
        with centroids of its own. Raises Conflict if another update came in between."""
        base = self.state()
        kind = next((r.schema["id"].dataType.simpleString() for r in (new, gone) if r is not None), base["id"])
        new = self.spark.createDataFrame([], f"id {kind}, embedding array<float>") if new is None else new.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
        size = norm(F.col("embedding"))
        fine = F.coalesce(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (size > 0) & (size < float("inf")), F.lit(False))
        rows = new.withColumn("x", F.when(fine, normalise(F.col("embedding"))))
        state = {**base, "id": kind, "source": source}
        if whole or state["centroids"] is None:
            state |= self._refit(rows)
            state["segments"] = []
        name = uuid.uuid4().hex
        segment = self._write(name, rows, self._centroids(state))
        segment["gone"] = 0
        if gone is not None and state["segments"]:
            gone = gone.select("id").distinct()
            gone.write.parquet(f"{self.path}/gone/segment={name}")
            segment["gone"] = self.spark.read.parquet(f"{self.path}/gone/segment={name}").count()
        if segment["rows"] or segment["gone"]:
            state["segments"] = [*state["segments"], segment | {"seq": 1 + max((s["seq"] for s in state["segments"]), default=0)}]
        state["version"] += 1
        try:
            self.versions.publish(state["version"], {k: v for k, v in state.items() if k != "version"})
        except Conflict:
            self._remove(name)
            raise
        return state

    def _refit(self, rows: DataFrame) -> dict:
        """New centroids of vectors of the most frequent length."""
        lengths = rows.filter("x IS NOT NULL").groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
        d, n = (lengths["d"], lengths["n"]) if lengths else (0, 0)
        found = fit(rows.filter(F.size("x") == d), min(MOST_CENTROIDS, max(1, -(-n // PARTITION_ROWS)))) if n else np.zeros((0, 0))
        name = uuid.uuid4().hex
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "centroid int, x array<double>")
        table.coalesce(1).write.parquet(f"{self.path}/centroids/{name}")
        return {"centroids": name, "fitted": n}

    def _write(self, name: str, rows: DataFrame, at: np.ndarray) -> dict:
        """The files of a segment: vectors by centroid, nearest first, with their distances."""
        half = 0.5 * (at * at).sum(1) if len(at) else np.zeros(0)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                centroid, far = np.full(batch.num_rows, FLAT, np.int32), np.zeros(batch.num_rows)
                known = np.asarray(lists.is_valid())
                length = np.asarray(lists.value_lengths().fill_null(0))
                centroid[known] = ODD
                mine = np.flatnonzero(known & (length == (at.shape[1] if len(at) else -1)))
                if len(mine):
                    x = lists.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), -1)
                    near = (x @ at.T - half).argmax(1)
                    centroid[mine], far[mine] = near, np.sqrt(((x - at[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(centroid), pa.array(far)], ["id", "embedding", "centroid", "far"])

        kind = rows.schema["id"].dataType.simpleString()
        dealt = rows.select("id", "embedding", "x").mapInArrow(assign, f"id {kind}, embedding array<float>, centroid int, far double").persist()
        facts = dealt.groupBy("centroid").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
        facts.coalesce(1).write.parquet(f"{self.path}/facts/segment={name}")
        facts = self.spark.read.schema("centroid int, n long, radius double").parquet(f"{self.path}/facts/segment={name}")
        total = facts.agg(F.sum("n")).first()[0] or 0
        files = facts.select("centroid", F.ceil(F.col("n") / FILE_ROWS).alias("files"))  # a row a centroid
        out = dealt.join(F.broadcast(files), "centroid").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
        out = out.repartition(len(at) + 2 + total // FILE_ROWS, "centroid", "file").sortWithinPartitions("centroid", "far").drop("files", "file")
        out.write.partitionBy("centroid").parquet(f"{self.path}/vectors/segment={name}")
        dealt.unpersist()
        return {"name": name, "rows": total}

    def _part(self, state: dict, part: str, schema: str, only: str) -> DataFrame:
        some = [s for s in state["segments"] if s[only]]
        if not some:
            return self.spark.createDataFrame([], f"{schema}, segment string, seq long")
        root = f"{self.path}/{part}"
        rows = self.spark.read.schema(f"{schema}, segment string").option("basePath", root).parquet(*[f"{root}/segment={s['name']}" for s in some])
        names = F.create_map(*[x for s in some for x in (F.lit(s["name"]), F.lit(s["seq"]).cast("long"))])
        return rows.withColumn("seq", F.element_at(names, F.col("segment")))

    def vectors(self, state: dict) -> DataFrame:
        return self._part(state, "vectors", f"id {state['id']}, embedding array<float>, far double, centroid int", "rows")

    def due(self) -> bool:
        """Whether the index has outgrown its centroids."""
        state = self.state()
        return sum(s["rows"] for s in state["segments"]) > GROWTH * max(state["fitted"], PARTITION_ROWS)

    # ---- search

    def reach(self, queries: DataFrame) -> DataFrame:
        """(query_id, query_vec, centroid, off, most, n): how far each query is from each centroid, and the
        largest cosine that a vector there can have."""
        state = self.state()
        facts = self._part(state, "facts", "centroid int, n long, radius double", "rows").groupBy("centroid").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        at = self.spark.read.schema("centroid int, x array<double>").parquet(f"{self.path}/centroids/{state['centroids']}")
        facts = broadcast_if_small(facts.join(at, "centroid", "left"))  # MOST_CENTROIDS + 2 rows at most
        q, size = F.col("query_vec"), norm(F.col("query_vec"))
        asked = queries.filter("query_vec IS NOT NULL").select("query_id", "query_vec", F.when(size > 0, normalise(q)).alias("u"))
        off = F.sqrt(F.aggregate(F.zip_with("u", "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        near = F.greatest(F.col("off") - F.col("radius"), F.lit(0.0))
        flat = (F.col("centroid") == FLAT) | F.col("u").isNull() | (F.size("u") != F.size("x"))
        most = F.when(F.col("centroid") == ODD, 1.0).when(flat, 0.0).otherwise(1 - near * near / 2)
        return facts.crossJoin(asked).withColumn("off", off).withColumn("most", most).select("query_id", "query_vec", "centroid", "off", "most", "n")

    def _scored(self, pairs: DataFrame, name: str) -> DataFrame:
        """(query_id, id, score) of live vectors of the pairs (query_id, query_vec, centroid, off, within):
        of those with a centroid, the ones whose distance from it differs from the query's by `within` at most."""
        state = self.state()
        some = [r[0] for r in pairs.select("centroid").distinct().collect()]  # MOST_CENTROIDS + 2 at most
        rows = self.vectors(state).filter(F.col("centroid").isin(some)).join(broadcast_if_small(pairs), "centroid")
        rows = rows.filter("centroid < 0 OR within IS NULL OR off IS NULL OR abs(off - far) <= within")
        score = F.when(F.col("centroid") == FLAT, F.lit(0.0)).otherwise(cosine(F.col("embedding"), F.col("query_vec")))
        found = rows.select("query_id", "id", "seq", score.alias(name))
        if any(s["gone"] for s in state["segments"]):
            last = self._part(state, "gone", f"id {state['id']}", "gone").groupBy("id").agg(F.max("seq").alias("gone"))
            found = found.join(last, "id", "left").filter("gone IS NULL OR gone <= seq")
        return found.select("query_id", "id", name)

    def needed(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, query_vec, centroid, off, within, n) of the partitions that can hold one of the k best."""
        reach = self.reach(queries).persist()
        self._kept.append(reach)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "off", "centroid"))
        seeds = reach.withColumn("place", place).filter(F.col("place") <= SEEDS).withColumn("within", F.lit(None).cast("double"))
        kth = ranked(self._scored(seeds, "score"), ["query_id"], "score", k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        out = reach.join(broadcast_if_small(kth), "query_id", "left").filter("least IS NULL OR most >= least - 1e-6")
        within = F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0))) + _SLACK  # a cosine of `least` or more is no farther
        out = out.select("query_id", "query_vec", "centroid", "off", F.when(F.col("least") > 0, within + math.sqrt(2 * _SLACK)).alias("within"), "n").persist()
        self._kept.append(out)
        return out

    def search(self, queries: DataFrame, k: int, name: str = "dense_score") -> DataFrame:
        """(query_id, id, score, rank) of the k vectors of largest cosine with query_vec."""
        if not any(s["rows"] for s in self.state()["segments"]):
            none = self.spark.createDataFrame([], f"id {self.state()['id']}, {name} double").join(queries.select("query_id").limit(0))
            return ranked(none.select("query_id", "id", name), ["query_id"], name, k)
        return ranked(self._scored(self.needed(queries, k), name), ["query_id"], name, k)

    def share(self, queries: DataFrame, k: int) -> float:
        """Share of all pairs of a query and a vector whose partitions a search reads after its threshold is known."""
        read, asked = self.needed(queries, k).agg(F.sum("n"), F.count_distinct("query_id")).first()
        return (read or 0) / max(1, asked * sum(s["rows"] for s in self.state()["segments"]))

    def release(self) -> None:
        """Give back what searches keep in memory."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    # ---- upkeep

    def _remove(self, name: str) -> None:
        for part in ("vectors", "facts", "gone"):
            self.versions.delete(f"{self.path}/{part}/segment={name}")

    def drop(self) -> None:
        """Remove the index and all its files."""
        self.release()
        self.versions.delete(self.path)

    def vacuum(self, older_than: float = 24 * 3600) -> None:
        """Remove what the newest version doesn't name and is older than so many seconds."""
        number = self.versions.newest()
        state = self.versions.read(number) if number else {"segments": [], "centroids": None}
        used = {s["name"] for s in state["segments"]} | {state["centroids"]}
        before = (time.time() - older_than) * 1000
        for part in ("facts", "centroids"):
            place, fs = self.versions._fs(f"{self.path}/{part}")
            for folder in fs.listStatus(place) if fs.exists(place) else []:
                name = folder.getPath().getName().removeprefix("segment=")
                if name not in used and folder.getModificationTime() <= before:
                    self._remove(name)
                    self.versions.delete(f"{self.path}/centroids/{name}")
        for old in self.versions.numbers():
            if old != number:
                self.versions.delete(f"{self.versions.path}/{old}")
