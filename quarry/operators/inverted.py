"""A stored BM25 index: segments that follow the documents, and blocks of postings that a search may skip.

An update writes one segment: the postings of new documents, the ids of documents that are gone, and how
both change the number of documents of each term. Statistics are sums over the segments; only the mean idf,
for which every term counts, is taken anew from the terms' counts. So an update reads and writes what came
and went, and a row a term. A posting is dead if a later segment lists its id as gone. Segments of like size
are merged by compact(), which drops dead postings; a posting is merged as often as its segment doubles.

Within a segment documents are dealt to slots of about SLOT_DOCS by a hash of their id. Postings are stored
sorted by term and slot, so those of a term in a slot are neighbours: a block. Of terms that are frequent there
is a head for each block, with the largest count and the least ratio of length to count, which bound what the
block can add to a score whatever the mean length is; the few postings of other terms are read to the same end.
A search

1. reads the heads of its terms' blocks and adds up the bounds per slot;
2. scores the most promising slots; the k-th best score is a threshold;
3. reads the blocks of the slots whose bounds together reach it. The result is that of scoring everything.

Words are counted in the row of their text; the postings are moved once, to the bucket of their term. Buckets follow the size of the segment, and a bucket is dealt to several files by slot where its
terms are frequent, so no task writes much more than FILE_POSTINGS.
"""

from __future__ import annotations

import math
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.bm25 import B, EPSILON, K1
from quarry.operators.common import broadcast_if_small, ranked
from quarry.operators.store import Conflict, Versions

SLOT_DOCS = 128
#: Documents that hold a term from which on it is frequent.
FREQUENT = 4 * SLOT_DOCS
#: Frequent terms up to which they are sent to all tasks.
MOST_OFTEN = 1_000_000
#: Ids that are gone up to which a compaction sends them to all tasks.
MOST_GONE = 2_000_000
#: Bytes of text for a posting, to tell their number before they are counted.
BYTES_A_POSTING = 8
#: Postings of a bucket and of a file on average; buckets at most.
BUCKET_POSTINGS, FILE_POSTINGS, MOST_BUCKETS = 1 << 22, 1 << 22, 4096
#: Segments that are merged at a time, at least.
FAN = 4
#: Slots that a search scores for its threshold: so many, and one more for each so many results asked for.
SEEDS, RESULTS_A_SEED = 4, 32
#: Slots up to which the scan is told which ones it should look for.
MOST_PUSHED = 64
_SLACK = 1e-8


def _slot(id_: Column, docs: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(max(1, -(-docs // SLOT_DOCS)))).cast("long")


def _postings(rows: DataFrame) -> DataFrame:
    """(id, term, tf, dl, first) of rows (id, text); first: whether the term is the document's first, so that
    these count the documents. Words are sorted and counted within the row, so that nothing is moved."""
    words = rows.select("id", tokens(F.col("text")).alias("words"))  # not filtered, which would cut the texts twice
    words = words.select("id", F.size("words").alias("dl"), F.get("words", F.lit(0)).alias("head"), F.sort_array("words").alias("words"))
    new = lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))
    starts = words.withColumn("starts", F.when(F.col("dl") > 0, F.filter(F.sequence(F.lit(0), F.col("dl") - 1), new)))
    run = lambda at, k: F.struct(F.get("words", at).alias("term"), (F.coalesce(F.get("starts", k + 1), F.col("dl")) - at).alias("tf"))
    one = starts.select("id", "dl", "head", F.inline(F.transform("starts", run)))
    return one.select("id", "term", "tf", "dl", (F.col("term") == F.col("head")).alias("first"))


def _bucket(term: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(count)).cast("int")


class Inverted:
    """An index below a path. Each update and compaction makes a version; a search goes by the newest, or
    by the one that pin() has fixed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/versions")
        self._pinned: dict | None = None
        self._kept: list[DataFrame] = []

    # ---- versions

    def state(self) -> dict:
        """segments, oldest first, the mean idf, the type of ids, and what the last update was made from."""
        if self._pinned is not None:
            return self._pinned
        number = self.versions.newest()
        if not number:
            return {"version": 0, "segments": [], "mean_idf": 0.0, "id": "long", "source": None}
        return self.versions.read(number) | {"version": number}

    def pin(self) -> Inverted:
        """Stay at the present version."""
        self._pinned = self.state()
        return self

    def _publish(self, state: dict) -> None:
        self.versions.publish(state["version"], {k: v for k, v in state.items() if k != "version"})

    # ---- updates

    def update(self, new: DataFrame | None, gone: DataFrame | None = None, source=None, whole: bool = False) -> dict:
        """Take in new rows (id, text), and take out gone ones (the rows as they were when they came). source:
        what this makes the index equal to, in the words of the caller. With `whole` the index starts anew.
        Raises Conflict if another update came in between."""
        base = {**self.state(), "segments": []} if whole else self.state()
        name = uuid.uuid4().hex
        kind = next((r.schema["id"].dataType.simpleString() for r in (new, gone) if r is not None), base["id"])
        empty = self.spark.createDataFrame([], f"id {kind}, text string")
        came, went = (new if new is not None else empty), (gone if gone is not None else empty)
        (docs, size), (less, gone_size) = self._extent(came), self._extent(went)
        if docs or less:
            segment = {"name": name, "live": docs, "buckets": self._buckets((size + gone_size) // BYTES_A_POSTING), "gone": less}
            self._write_postings(segment, _postings(came))
            lost = _postings(went).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("words"), F.count_if("first").alias("docs"))
            self._write_rest(segment, self._counted(segment), lost, went.select("id").distinct() if less else None)
            base["segments"] = [*base["segments"], segment]
        state = {**base, "id": kind, "source": source}
        state["mean_idf"] = self._mean_idf({**state, "segments": self._numbered(state["segments"])})
        while True:
            state |= {"version": state["version"] + 1, "segments": self._numbered(state["segments"])}
            try:
                self._publish(state)
                return state
            except Conflict:
                now = self.state()
                if whole or now["source"] != base["source"]:
                    self._remove(name)
                    raise
            # a compaction came in between, which changes no statistics
            state |= {"version": now["version"], "segments": [*now["segments"], *[{k: v for k, v in s.items() if k != "seq"} for s in state["segments"] if s["name"] == name]]}

    @staticmethod
    def _buckets(count: int) -> int:
        return min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, count) / BUCKET_POSTINGS))))

    @staticmethod
    def _numbered(segments: list[dict]) -> list[dict]:
        """Segments, of which the last may have no number, with the next one for it."""
        last = max((s["seq"] for s in segments if "seq" in s), default=0)
        return [s if "seq" in s else {**s, "seq": last + 1} for s in segments]

    @staticmethod
    def _extent(rows: DataFrame) -> tuple[int, int]:
        """Number of rows (id, text), and bytes of their texts."""
        return tuple(x or 0 for x in rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first())

    def _write_postings(self, segment: dict, rows: DataFrame) -> None:
        """rows: id, term, tf, dl, first, by bucket of the term. What is moved is term, id and one number."""
        count, docs = segment["buckets"], segment["live"]
        slot, bucket = _slot(F.col("id"), docs), _bucket(F.col("term"), count)
        packed = F.call_function("shiftleft", F.col("tf").cast("long"), F.lit(33)) + F.col("dl").cast("long") * 2 + F.col("first").cast("long")
        # a bucket gets more files than one if its terms may be in so many documents
        file = F.pmod(F.xxhash64(slot), F.lit(max(1, -(-docs // FILE_POSTINGS))))
        moved = rows.select("term", "id", packed.alias("packed")).repartition(bucket, file)
        low = F.call_function("shiftright", F.col("packed"), F.lit(1)).bitwiseAND(F.lit((1 << 32) - 1))
        out = moved.select(
            bucket.alias("bucket"),
            "term",
            slot.alias("slot"),
            "id",
            F.call_function("shiftright", F.col("packed"), F.lit(33)).cast("int").alias("tf"),
            low.cast("int").alias("dl"),
            (F.col("packed").bitwiseAND(F.lit(1)) == 1).alias("first"),
        )
        out = out.sortWithinPartitions("bucket", "term", "slot", "id")
        out.write.option("parquet.page.row.count.limit", "4096").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment['name']}")

    def _counted(self, segment: dict) -> DataFrame:
        """(term, df, words, docs): of each term the postings, their counts, and documents that begin with it."""
        rows = self.spark.read.schema("term string, tf int, first boolean").parquet(f"{self.path}/postings/segment={segment['name']}")
        return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("words"), F.count_if("first").alias("docs"))

    def _write_rest(self, segment: dict, came: DataFrame, went: DataFrame | None, gone: DataFrame | None, change: DataFrame | None = None) -> None:
        """How a segment changes the counts of terms (by what came and went, unless `change` says it), the heads
        of frequent terms, and the ids that are gone; and into segment its sizes."""
        count, at = segment["buckets"], f"segment={segment['name']}"
        came = came.persist()
        went = went.persist() if went is not None else None  # or the texts that are gone are cut into words twice
        sums = lambda c: tuple(x or 0 for x in c.agg(F.sum("docs"), F.sum("words"), F.sum("df")).first())
        docs, words, segment["postings"] = sums(came)
        if change is None:
            less, fewer, _ = sums(went) if gone is not None else (0, 0, 0)
            segment |= {"docs": docs - less, "words": words - fewer}
            negative = went.select("term", (-F.col("df")).alias("df"))
            change = came.select("term", "df") if gone is None else came.select("term", "df").unionByName(negative).groupBy("term").agg(F.sum("df").alias("df"))
        by = change.filter("df <> 0").withColumn("bucket", _bucket(F.col("term"), count)).repartition("bucket").sortWithinPartitions("bucket", "term")
        by.write.partitionBy("bucket").parquet(f"{self.path}/terms/{at}")
        often = came.filter(F.col("df") >= FREQUENT).select("term")
        rows = self.spark.read.schema("term string, slot long, tf int, dl int, bucket int").parquet(f"{self.path}/postings/{at}")
        heads = rows.join(broadcast_if_small(often, MOST_OFTEN), "term", "left_semi").groupBy("bucket", "term", "slot").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min(F.col("dl") / F.col("tf")).alias("least_ratio")
        )
        heads = heads.repartition("bucket").sortWithinPartitions("bucket", "term", "slot")
        heads.write.partitionBy("bucket").parquet(f"{self.path}/heads/{at}")
        if gone is not None:
            gone.write.parquet(f"{self.path}/gone/{at}")
        came.unpersist()
        if went is not None:
            went.unpersist()

    def _part(self, state: dict, part: str, schema: str, only=lambda s: True) -> DataFrame:
        """One of the tables of all segments, with the segment's number."""
        some = [s for s in state["segments"] if only(s)]
        schema = f"{schema}, segment string" + ("" if part == "gone" else ", bucket int")
        if not some:
            return self.spark.createDataFrame([], f"{schema}, seq long")
        root = f"{self.path}/{part}"
        rows = self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/segment={s['name']}" for s in some])
        names = F.create_map(*[x for s in some for x in (F.lit(s["name"]), F.lit(s["seq"]).cast("long"))])
        return rows.withColumn("seq", F.element_at(names, F.col("segment")))

    def postings(self, state: dict | None = None) -> DataFrame:
        state = state or self.state()
        return self._part(state, "postings", f"term string, slot long, id {state['id']}, tf int, dl int, first boolean", lambda s: s["postings"])

    def heads(self, state: dict | None = None) -> DataFrame:
        return self._part(state or self.state(), "heads", "term string, slot long, n long, most_tf int, least_ratio double", lambda s: s["postings"])

    def gone(self, state: dict) -> DataFrame:
        return self._part(state, "gone", f"id {state['id']}", lambda s: s["gone"])

    def counts(self, state: dict) -> DataFrame:
        return self._part(state, "terms", "term string, df long")

    # ---- statistics

    @staticmethod
    def _sizes(state: dict) -> tuple[int, int]:
        return sum(s["docs"] for s in state["segments"]), sum(s["words"] for s in state["segments"])

    def _raw(self, counted: DataFrame, n: int) -> DataFrame:
        df = counted.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))

    def _mean_idf(self, state: dict) -> float:
        return self._raw(self.counts(state), self._sizes(state)[0]).agg(F.avg("raw")).first()[0] or 0.0

    def terms(self, wanted: DataFrame | None = None) -> DataFrame:
        """(term, df, idf) of all terms, or of those of wanted (term)."""
        state = self.state()
        rows = self.counts(state)
        if wanted is not None:
            rows = self._of(rows, state, wanted).join(wanted, "term", "left_semi")
        floor = EPSILON * state["mean_idf"]
        return self._raw(rows, self._sizes(state)[0]).select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))

    def _of(self, rows: DataFrame, state: dict, wanted: DataFrame) -> DataFrame:
        """rows of the buckets that the wanted terms fall into; there are MOST_BUCKETS values at most."""
        for count in {s["buckets"] for s in state["segments"]}:
            of = F.col("segment").isin([s["name"] for s in state["segments"] if s["buckets"] == count])
            if count > 1:
                found = [r[0] for r in wanted.select(_bucket(F.col("term"), count)).distinct().collect()]
                rows = rows.filter(~of | F.col("bucket").isin(found))
        return rows

    # ---- search

    def _weighed(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, weight), a term's weight being its idf as often as the query has it."""
        wanted = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        idf = self.terms(wanted.select("term").distinct())
        out = wanted.join(broadcast_if_small(idf), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")).persist()
        self._kept.append(out)
        return out

    def bounds(self, weighed: DataFrame) -> DataFrame:
        """(query_id, segment, slot, bound, postings): what a document of a slot can score at most, and how many
        postings it has of the query's terms. Of frequent terms only the heads are read."""
        state = self.state()
        n, words = self._sizes(state)
        heads = self._of(self.heads(state), state, weighed).select("segment", "slot", "term", "n", "most_tf", "least_ratio")
        often = self._of(self.heads(state), state, weighed).select("segment", "term").distinct().join(weighed.select("term").distinct(), "term", "left_semi")
        rare = weighed.select("term").distinct().crossJoin(F.broadcast(self._names(state))).join(often, ["segment", "term"], "left_anti")
        rows = self._of(self.postings(state), state, weighed).join(broadcast_if_small(rare), ["segment", "term"], "left_semi")
        few = rows.groupBy("segment", "slot", "term").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min(F.col("dl") / F.col("tf")).alias("least_ratio"))
        least = 1 + K1 * (1 - B) / F.col("most_tf") + K1 * B / (words / max(n, 1) or 1.0) * F.col("least_ratio")
        bound = F.greatest(F.lit(0.0), F.col("weight")) * (K1 + 1) / least
        heads = heads.unionByName(few).join(broadcast_if_small(weighed), "term")
        return heads.groupBy("query_id", "segment", "slot").agg(F.sum(bound).alias("bound"), F.sum("n").alias("postings"))

    def _names(self, state: dict) -> DataFrame:
        """The segments' names, a few."""
        return self.spark.createDataFrame([(s["name"],) for s in state["segments"]], "segment string")

    def _scored(self, weighed: DataFrame, slots: DataFrame | None) -> DataFrame:
        """(query_id, id, bm25_score) of the live documents of slots (query_id, segment, slot), or of all."""
        state = self.state()
        n, words = self._sizes(state)
        rows = self._of(self.postings(state), state, weighed)
        if slots is not None:
            named = [r[0] for r in slots.select("slot").distinct().limit(MOST_PUSHED + 1).collect()]
            if 0 < len(named) <= MOST_PUSHED:
                rows = rows.filter(reduce(lambda a, b: a | b, [F.col("slot") == s for s in named]))
        rows = rows.join(broadcast_if_small(weighed), "term")
        if slots is not None:
            rows = rows.join(broadcast_if_small(slots), ["query_id", "segment", "slot"], "left_semi")
        mean = words / max(n, 1) or 1.0
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        found = rows.groupBy("query_id", "id", "seq").agg(F.sum(part).alias("bm25_score"))
        if any(s["gone"] for s in state["segments"]):
            last = self.gone(state).groupBy("id").agg(F.max("seq").alias("gone"))
            found = found.join(last, "id", "left").filter("gone IS NULL OR gone <= seq")
        return found.select("query_id", "id", "bm25_score")

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, bm25_score) of all documents that hold a term of the query."""
        return self._scored(self._weighed(queries), None)

    def needed(self, weighed: DataFrame, k: int) -> DataFrame:
        """(query_id, segment, slot, postings) that can hold one of a query's k best."""
        bounds = self.bounds(weighed).persist()
        self._kept.append(bounds)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "slot"))
        seeds = bounds.withColumn("place", place).filter(F.col("place") <= SEEDS + k // RESULTS_A_SEED).select("query_id", "segment", "slot")
        kth = ranked(self._scored(weighed, seeds), ["query_id"], "bm25_score", k).filter(F.col("rank") == k).select("query_id", F.col("bm25_score").alias("least"))
        out = bounds.join(broadcast_if_small(kth), "query_id", "left").filter((F.col("bound") > 0) & (F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)))
        out = out.select("query_id", "segment", "slot", "postings").persist()
        self._kept.append(out)
        return out

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best of each query, of these the positive ones."""
        weighed = self._weighed(queries)
        return ranked(self._scored(weighed, self.needed(weighed, k)), ["query_id"], "bm25_score", k).filter("bm25_score > 0")

    def drop(self) -> None:
        """Remove the index and all its files."""
        self.release()
        self.versions.delete(self.path)

    def release(self) -> None:
        """Give back what searches keep in memory."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    # ---- compaction

    @staticmethod
    def run(segments: list[dict]) -> int:
        """Where the longest run of last segments begins of which each is small or no larger than all after it, or
        their number if that would merge fewer than FAN."""
        size = lambda s: s["postings"] + s["gone"]
        at = start = len(segments)
        after = 0
        while at:
            at -= 1
            if after and size(segments[at]) > max(after, BUCKET_POSTINGS >> 4):
                break
            after += size(segments[at])
            start = at
        return start if len(segments) - start >= FAN else len(segments)

    def compact(self, start: int | None = None) -> bool:
        """Merge the last segments from `start` on (by default, as run() says) into one; whether there was
        something to do. It may run beside updates: those that come meanwhile stay as they are, and if
        another compaction was first, what this one wrote is removed."""
        base = self.state()
        start = self.run(base["segments"]) if start is None else start
        some = base["segments"][start:]
        if len(some) < 2:
            return False
        part = {**base, "segments": some}
        rows = self.postings(part)
        last = self.gone(part).groupBy("id").agg(F.max("seq").alias("gone"))
        live = sum(s["live"] for s in some)
        # few ids go to the postings, which else are moved by id only to be moved again by term
        rows = rows.join(broadcast_if_small(last, MOST_GONE), "id", "left").filter("gone IS NULL OR gone <= seq").select("id", "term", "tf", "dl", "first")
        gone = self.gone(part).select("id").distinct() if start and any(s["gone"] for s in some) else None
        segment = {"name": uuid.uuid4().hex, "live": live, "docs": sum(s["docs"] for s in some), "words": sum(s["words"] for s in some), "gone": sum(s["gone"] for s in some) if start else 0, "seq": some[-1]["seq"]}
        segment["buckets"] = self._buckets(sum(s["postings"] for s in some))
        self._write_postings(segment, rows)
        self._write_rest(segment, self._counted(segment), None, gone, self.counts(part).groupBy("term").agg(F.sum("df").alias("df")))
        names = [s["name"] for s in some]
        while True:
            now = self.state()
            held = [s["name"] for s in now["segments"]]
            at = held.index(names[0]) if names[0] in held else -1
            if at < 0 or held[at : at + len(names)] != names:
                self._remove(segment["name"])
                return False
            after = {**now, "version": now["version"] + 1, "segments": [*now["segments"][:at], segment, *now["segments"][at + len(names) :]]}
            try:
                self._publish(after)
                return True
            except Conflict:
                continue

    def _remove(self, name: str) -> None:
        for part in ("postings", "heads", "terms", "gone"):
            self.versions.delete(f"{self.path}/{part}/segment={name}")

    def vacuum(self, older_than: float = 24 * 3600) -> None:
        """Remove the segments that the newest version doesn't name and that are older than so many seconds,
        and the versions before it."""
        number = self.versions.newest()
        used = {s["name"] for s in self.versions.read(number)["segments"]} if number else set()
        place, fs = self.versions._fs(f"{self.path}/terms")
        before = (time.time() - older_than) * 1000
        for folder in fs.listStatus(place) if fs.exists(place) else []:
            name = folder.getPath().getName().removeprefix("segment=")
            if name not in used and folder.getModificationTime() <= before:
                self._remove(name)
        for old in self.versions.numbers():
            if old != number:
                self.versions.delete(f"{self.versions.path}/{old}")
