"""Line deduplication with sharded cuckoo filters over exact reference-count tables.

State, all as tables in the shared folder:

* postings (shard, key, doc_id): which document holds which line key, exactly;
* counts (shard, key, refs, owner): the reference count of a key, that is, in how many documents it
  stands, and its owner, the smallest doc_id among them, as each key came in first;
* shared (shard, key, refs, owner): the same of the keys that more than one document holds, up to date;
* filters (shard, size, bits): one cuckoo filter of the keys of each shard, and how many it holds.

insert() asks the filters of the touched shards which of the new keys may be known. Only these are
looked up in the exact table, and a key becomes shared either within its batch or by such a look-up;
a key that its filter doesn't know goes into counts and filter unseen. rewrite() reads shared alone,
so what is dropped has come through the filters and has been confirmed exactly: false positives
change nothing, and a filter has no false negatives. dedup() inserts its documents in BATCHES.

delete() lowers the counts, gives keys new owners, and takes keys that no document holds any more
out of the filters, so a document's insertion can be undone. A filter that would be over FULL is built
anew, twice as large as needed, from the exact table of its shard.

A key is the 128-bit digest of the line, stripped of ASCII white space and with A-Z in lower case.
Keys shorter than `min_chars` code points are never dropped. Counting aggregates before it shuffles,
so a line that a third of the documents share costs a row per task, and its postings meet its owner
by a broadcast of hot keys.

Defined results: null or empty text is one empty line; rows that share a doc_id are one document;
documents that the state holds already are not inserted again; rows of null doc_id are not indexed
and keep all lines; very long texts are cut into lines whole; an empty table gives an empty table.
Extra columns pass through rewrite(), whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, fresh_name, join_hot, materialize, repeats, result_name

MIN_CHARS = 10
#: Fixed value: the white space of the contract.
SPACES = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 1 << 18
#: Batches in which dedup() inserts, and the load from which a filter is built anew.
BATCHES, FULL = 2, 0.85


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in either of two buckets."""

    SLOTS = 4

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def empty(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / cls.SLOTS / 0.8))))
        return cls(np.zeros((buckets, cls.SLOTS), "<u2"))

    def room(self) -> int:
        """Keys that fit before the filter is over FULL."""
        return int(FULL * self.table.size)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, cls.SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = ((h >> np.uint64(48)) | np.uint64(1)).astype("<u2")
        first = h & self.mask
        return marks, first.astype(np.int64), self._other(first, marks)

    def _other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        turn = (marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return ((bucket.astype(np.uint64) ^ turn) & self.mask).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        marks, a, b = self._places(h)
        return ((self.table[a] == marks[:, None]) | (self.table[b] == marks[:, None])).any(axis=1)

    def _place(self, marks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; True where that worked."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        nth = np.arange(len(at)) - np.searchsorted(sorted_at, sorted_at)
        free = self.table[sorted_at] == 0
        slots = np.argsort(~free, axis=1, kind="stable")
        fits = nth < free.sum(axis=1)
        slot = slots[np.arange(len(at)), np.minimum(nth, self.SLOTS - 1)]
        self.table[sorted_at[fits], slot[fits]] = marks[order][fits]
        out = np.zeros(len(at), bool)
        out[order] = fits
        return out

    def insert(self, h: np.ndarray) -> bool:
        """Insert distinct keys; False if the filter is too full, and then it must be built anew."""
        marks, a, b = self._places(h)
        for side in (0, 1):
            done = self._place(marks, b if side else a)
            marks, a, b = marks[~done], a[~done], b[~done]
            if not len(marks):
                return True
        turn = 0
        for mark, bucket in zip(marks.tolist(), b.tolist(), strict=True):
            for _ in range(500):
                row = self.table[bucket]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = mark
                    break
                turn += 1
                slot = turn % self.SLOTS
                mark, row[slot] = int(row[slot]), mark
                bucket = int(self._other(np.array([bucket]), np.array([mark], "<u2"))[0])
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Take out keys that were inserted; one slot for each."""
        marks, a, b = self._places(h)
        for mark, one, two in zip(marks.tolist(), a.tolist(), b.tolist(), strict=True):
            for bucket in (one, two):
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break


def _hash(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[8:] for k in keys), "<u8")


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None if it is too short to be dropped."""
    raw = line.encode().strip(SPACES).lower()
    if len(raw) < min_chars or (len(raw) < 4 * min_chars and len(raw.decode()) < min_chars):
        return None
    return hashlib.md5(raw, usedforsecurity=False).digest()


@dataclass
class LineState:
    postings: DataFrame
    counts: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int

    POSTINGS = "shard int, key binary, doc_id long"
    COUNTS = "shard int, key binary, refs long, owner long"
    FILTERS = "shard int, size long, bits binary"

    @classmethod
    def empty(cls, spark: SparkSession, shards: int) -> LineState:
        make = lambda schema: spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.split(", "))])
        return cls(make(cls.POSTINGS), make(cls.COUNTS), make(cls.COUNTS), make(cls.FILTERS), shards)


def postings(docs: DataFrame, shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(shard, key, doc_id), once for each row and key."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<binary>")
    def keys(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found = {line_key(x, min_chars) for x in text.split("\n")} if text else set()
            found.discard(None)
            out.append(list(found))
        return pa.array(out, pa.list_(pa.binary()))

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.explode(keys(F.col("text").cast("string"))).alias("key"))
    return rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "doc_id")


def _count(rows: DataFrame) -> DataFrame:
    """Reference counts and owners of distinct postings."""
    return rows.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("owner"))


def _filter_of(rows: pd.DataFrame) -> CuckooFilter | None:
    return CuckooFilter.from_bytes(rows["bits"].iloc[0]) if len(rows) else None


def _probe(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """keys (shard, key) with `maybe`: whether the shard's filter may hold the key."""

    def ask(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        table = _filter_of(old)
        maybe = np.zeros(len(new), bool) if table is None or not len(new) else table.contains(_hash(list(new["key"])))
        return pd.DataFrame({"shard": new["shard"], "key": new["key"], "maybe": maybe})

    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(ask, "shard int, key binary, maybe boolean")


def _extend_filters(unseen: DataFrame, counts: DataFrame, filters: DataFrame) -> DataFrame:
    """The filters with the keys of unseen (shard, key) put in. Where one would be over FULL, it is built
    anew from the exact counts of its shard and the unseen keys, with room for twice as many."""

    def put(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        table, held = _filter_of(old), int(old["size"].iloc[0]) if len(old) else 0
        full = False
        if len(new):
            table = table or CuckooFilter.empty(len(new))
            full = held + len(new) > table.room() or not table.insert(_hash(list(new["key"])))
        return pd.DataFrame({"shard": [key[0]], "size": [held + len(new)], "bits": [None if full else table.to_bytes()]})

    out = materialize(unseen.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(put, LineState.FILTERS))
    full = out.filter("bits IS NULL").select("shard")
    if full.isEmpty():
        return out
    whole = counts.select("shard", "key").unionByName(unseen).join(full, "shard", "left_semi")
    return materialize(out.filter("bits IS NOT NULL").unionByName(build_filters(whole)))


def build_filters(keys: DataFrame) -> DataFrame:
    """Filters of the distinct keys (shard, key), with room for twice as many; larger ones where one fails."""

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        marks, room = _hash(list(rows["key"])), 2 * len(rows)
        while not (table := CuckooFilter.empty(room)).insert(marks):
            room *= 2
        return pd.DataFrame({"shard": [key[0]], "size": [len(rows)], "bits": [table.to_bytes()]})

    return keys.groupBy("shard").applyInPandas(build, LineState.FILTERS)


def shards_for(docs: DataFrame) -> int:
    """Shards so that each has about KEYS_PER_SHARD keys, from the number of line ends."""
    lines = docs.agg(F.sum(F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")))).first()[0] or 0
    return max(1, -(-lines // KEYS_PER_SHARD))


def insert(state: LineState, docs: DataFrame) -> LineState:
    """The state after the documents of docs have come in; those that it holds already are left out."""
    if not state.postings.isEmpty():
        docs = docs.join(state.postings.select("doc_id").distinct(), "doc_id", "left_anti")
    new = postings(docs, state.shards)
    return insert_postings(state, materialize(new.distinct() if repeats(docs.filter("doc_id IS NOT NULL")) else new))


def insert_postings(state: LineState, new: DataFrame) -> LineState:
    """The state with new postings, distinct and of documents that it doesn't hold."""
    by = ["shard", "key"]
    fresh = materialize(_count(new))
    asked = materialize(_probe(fresh.select(*by), state.filters)) if not state.filters.isEmpty() else fresh.select(*by, F.lit(False).alias("maybe"))
    # the exact look-up, of nothing but what the filters let through
    known = materialize(state.counts.join(asked.filter("maybe").select(*by), by, "left_semi"))
    unseen = fresh.join(known.select(*by), by, "left_anti")
    before = known.join(state.shared.select(*by, F.col("refs").alias("r"), F.col("owner").alias("o")), by, "left")
    before = before.select(*by, F.coalesce("r", "refs").alias("refs"), F.coalesce("o", "owner").alias("owner"))
    again = before.unionByName(fresh.join(known.select(*by), by, "left_semi")).groupBy(*by).agg(F.sum("refs").alias("refs"), F.min("owner").alias("owner"))
    shared = state.shared.join(known.select(*by), by, "left_anti").unionByName(again).unionByName(unseen.filter("refs > 1"))
    filters = _extend_filters(unseen.select(*by), state.counts, state.filters)
    counts = unseen if state.counts.isEmpty() else state.counts.unionByName(unseen)
    rows = new if state.postings.isEmpty() else state.postings.unionByName(new)
    return LineState(rows, materialize(counts), materialize(shared), filters, state.shards)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state as if the documents of doc_ids (doc_id) had never come in."""
    by = ["shard", "key"]
    gone = materialize(state.postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*by).distinct())
    left = materialize(state.postings.join(doc_ids.select("doc_id"), "doc_id", "left_anti").select(*by, "doc_id"))
    again = materialize(_count(left.join(gone, by, "left_semi")))
    counts = materialize(state.counts.join(gone, by, "left_anti").unionByName(again))
    shared = materialize(state.shared.join(gone, by, "left_anti").unionByName(again.filter("refs > 1")))
    dead = gone.join(again.select(*by), by, "left_anti")

    def take_out(key, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if not len(old) or not len(keys):
            return old
        table = _filter_of(old)
        table.delete(_hash(list(keys["key"])))
        return pd.DataFrame({"shard": [key[0]], "size": [int(old["size"].iloc[0]) - len(keys)], "bits": [table.to_bytes()]})

    filters = state.filters.groupBy("shard").cogroup(dead.groupBy("shard")).applyInPandas(take_out, LineState.FILTERS)
    return LineState(left, counts, shared, materialize(filters), state.shards)


def rewrite(docs: DataFrame, state: LineState, text: str = "text", min_chars: int = MIN_CHARS, to: str | None = None) -> DataFrame:
    """docs with its text less the lines whose keys other, smaller documents hold too, and `to` (`lines`,
    with underscores before it where docs has one): struct of n_lines (before) and n_dropped. Needs doc_id."""
    bounded_batches(docs.sparkSession)
    lost = join_hot(state.postings, state.shared, ["shard", "key"], "refs").filter("doc_id <> owner")
    name, own = fresh_name(docs, "lost"), fresh_name(docs, "lost_id")
    lost = lost.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("key").alias(name))

    @F.arrow_udf("struct<text: string, n_lines: long, n_dropped: long>")
    def keep(texts: pa.Array, lost: pa.Array) -> pa.Array:
        kept, total, dropped = [], [], []
        for value, keys in zip(texts.to_pylist(), lost.to_pylist(), strict=True):
            lines = (value or "").split("\n")
            stay = lines
            if keys:
                bad = set(keys)
                stay = [x for x in lines if line_key(x, min_chars) not in bad]
            kept.append("\n".join(stay) if len(stay) < len(lines) else value)
            total.append(len(lines))
            dropped.append(len(lines) - len(stay))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    out = docs.join(lost.hint("shuffle_hash"), docs["doc_id"] == lost[own], "left")
    result = fresh_name(docs, "kept")
    out = out.withColumn(result, keep(F.col(text).cast("string"), F.col(name)))
    return out.select(*[F.col(f"{result}.text").alias(text) if c == text else docs[c] for c in docs.columns], F.struct(f"{result}.n_lines", f"{result}.n_dropped").alias(to or result_name(docs, "lines")))


def dedup(docs: DataFrame, batches: int = BATCHES, to: str | None = None) -> DataFrame:
    """rewrite() of docs by a state that holds just these documents, inserted in batches."""
    state = LineState.empty(docs.sparkSession, shards_for(docs))
    rows = postings(docs, state.shards)
    if repeats(docs.filter("doc_id IS NOT NULL")):
        rows = rows.distinct()
    rows = materialize(rows)
    for i in range(batches):
        state = insert_postings(state, rows.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(batches)) == i))
    state.postings = rows  # the batches together
    return rewrite(docs, state, to=to)


def digests(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, (o.key IS NOT NULL AND o.owner <> k.doc_id) AS lost FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
