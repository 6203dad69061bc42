"""Similarity join of documents on the Jaccard similarity of their word n-grams, by MinHash bands.

1. Documents with the same words are one class; the smallest doc_id stands for it.
2. Representatives get MinHash signatures. The number of bands and rows is the cheapest that
   reaches the target recall at the threshold.
3. Representatives meet on band hashes; places of one are dropped before signatures are sent to them.
   A place is read as a stream: each newcomer is compared, by one byte of each minimum, with the leaders
   met so far, and linked to those that may be similar; a newcomer very close to a leader isn't kept as
   a leader itself, since whatever is similar to it is close to that leader too. So a place of m copies
   costs m rows, not m * m. A place of over PLACE rows is dealt out over tasks, whose leaders are then
   compared with one another, a pair of tasks' leaders to a task.
4. The links' connected components are the neighbourhoods within which pairs are verified, all
   pairs against all, on the full n-gram sets; large neighbourhoods are dealt out as pairs of
   blocks of BLOCK documents. Only counts and the links of a spanning forest leave a task.
5. The components of the verified links are the classes.

Copies, neighbourhoods, places and stars that hold a large share of all rows meet their one row of facts
by a broadcast of hot keys (common.join_hot).

Result per document: class_id (the smallest doc_id of its class) and n_links (how many other
documents are similar to it, copies included).

A word is a run of characters other than ASCII white space, in lower case. N-grams are compared by
64-bit digests. Defined results: a document of fewer than n words has one n-gram, all its words; null,
empty and blank texts are similar to nothing; rows of null doc_id get a null class and no links;
rows that share a doc_id are one document, with the n-grams of each of them; very long texts are read
whole; an empty table gives an empty table. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, fresh_name, join_hot, materialize, repeats, result_name
from quarry.llm.components import connected_components

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
MAX_MINIMA = 256
BLOCK = 256
#: Estimates from which a newcomer is linked to a leader, and from which it isn't kept as one.
#: If J(x, leader) >= 1 - e then what is similar to x at t has J(leader) >= t - e.
LINK_FROM, CLOSE_FROM = 0.45, 0.88
#: Rows of a place that one task reads, and the estimate from which leaders of two tasks are linked: what
#: each stands for may be 1 - CLOSE_FROM away from it.
PLACE, LINK_ACROSS = 4096, 0.35
#: Bytes of text that are cut into words at once.
SLICE = 1 << 19

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def choose_bands(threshold: float, recall: float, most: int = MAX_MINIMA) -> tuple[int, int]:
    """(bands, rows): the steepest choice that finds a pair at the threshold with `recall`,
    within twice the fewest minima that do so with three rows or more, and `most`."""
    options = []
    for rows in range(1, 13):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                options.append((rows, bands))
                break
    if not options:
        raise ValueError(f"{most} minima can't reach a recall of {recall} at {threshold}")
    least = min((r * b for r, b in options if r >= 3), default=min(r * b for r, b in options))
    rows, bands = max((r, b) for r, b in options if r * b <= 2 * least)
    return bands, rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(99)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of raw, in order."""
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    kept = data[inside]
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(kept)) - np.repeat(first, sizes)
    values = _BYTE[kept] * _PLACE[place & 255]
    if sizes.max() > 256:
        far = place > 255
        values[far] = _mix(values[far] + (place[far] >> 8).astype(np.uint64))
    return _mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def shingles(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of word hashes."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _GRAM[i % 64] + np.uint64(i // 64)
    return np.unique(_mix(total + np.uint64(n)))


def text_words(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    at = 0
    raws = [(x or "").lower().encode() for x in texts]
    while at < len(raws):
        size, to = 0, at
        while to < len(raws) and (to == at or size + len(raws[to]) <= SLICE):
            size += len(raws[to]) + 1
            to += 1
        part = raws[at:to]
        words = word_hashes(b"\n".join(part))
        marks = np.frombuffer(b"\n".join(part), np.uint8)
        inside = ~_SPACE[marks]
        begins = inside & ~np.concatenate([[False], inside[:-1]])
        upto = np.concatenate([[0], np.cumsum(begins)])
        ends = np.cumsum([len(x) + 1 for x in part]) - 1
        starts = ends - np.array([len(x) for x in part])
        out += [words[upto[a] : upto[b]] for a, b in zip(starts, ends, strict=True)]
        at = to
    return out


class Signer:
    """Minima of a fixed family of hash functions over n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row per set, which must not be empty."""
        flat = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        out = np.empty((len(sets), len(self.factor)), np.uint32)
        for i, (f, s) in enumerate(zip(self.factor, self.shift, strict=True)):
            x = low * f + s
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            out[:, i] = np.minimum.reduceat(x, starts)
        return out

    def band_hashes(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit hash per set and band; bands have different ones for equal minima."""
        cut = minima.reshape(len(minima), self.bands, self.rows).astype(np.uint64)
        total = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) << np.uint64(40), cut.shape[:2]).copy()
        for i in range(self.rows):
            total = _mix(total + cut[:, :, i] * _GRAM[i])
        return total


def gram_sets(docs: list[list[str | None]], n: int) -> tuple[list[np.ndarray], list[bytes]]:
    """N-grams of documents given as lists of texts, and a digest of their words; none and b"" without words."""
    words = iter(text_words([x for d in docs for x in d]))
    sets, keys = [], []
    for d in docs:
        own = [w for w in (next(words) for _ in d) if len(w)]
        found = sorted({hashlib.md5(w.tobytes(), usedforsecurity=False).digest() for w in own})
        keys.append(found[0] if len(found) == 1 else found and hashlib.md5(b"".join(found), usedforsecurity=False).digest() or b"")
        grams = [shingles(w, n) for w in own]
        sets.append(grams[0] if len(grams) == 1 else np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64))
    return sets, keys


def whole_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, texts): a row per doc_id with the texts of its rows."""
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if repeats(rows):
        return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    return rows.select("doc_id", F.array("text").alias("texts"))


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """(doc_id, words_key, bands, marks) of the documents (doc_id, texts) that have words."""

    def sign(batches):
        signer = Signer(bands, rows)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                sets, keys = gram_sets(texts[at : at + 256], n)
                some = [i for i, k in enumerate(keys) if k]
                if not some:
                    continue
                minima = signer.minima([sets[i] for i in some])
                hashes = signer.band_hashes(minima).view(np.int64)
                marks = (minima >> np.uint32(7)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : at + 256][some], pa.int64()),
                        pa.array([keys[i] for i in some], pa.binary()),
                        pa.array(list(hashes), pa.list_(pa.int64())),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    ["doc_id", "words_key", "bands", "marks"],
                )

    return docs.select("doc_id", "texts").mapInArrow(sign, "doc_id long, words_key binary, bands array<long>, marks binary")


class Forest:
    """Union-find over small integers."""

    def __init__(self):
        self.up: list[int] = []

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _guess(marks: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarities of rows of marks, broadcast, less the bytes that agree by chance."""
    return ((marks == other).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _meet(batches):
    """Links among the members of each part of a meeting place, rows sorted by place and part; of places
    in several parts their leaders too, as rows without b."""
    task, leaders, ids, forest, used, split = None, np.empty((16, 0), np.uint8), [], Forest(), 0, False
    out: list[tuple] = []

    def done():
        if split:
            out.extend((ids[i], None, *task, leaders[i].tobytes()) for i in range(used))

    def rows():
        cols = list(zip(*out, strict=True))
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["a", "b", "place", "part", "marks"])

    for batch in batches:
        for p, part, parts, d, m in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            v = np.frombuffer(m, np.uint8)
            if (p, part) != task:
                done()
                task, ids, forest, used, split = (p, part), [], Forest(), 0, parts > 1
                if leaders.shape[1] != len(v) or len(leaders) > 4096:
                    leaders = np.empty((16, len(v)), np.uint8)
            elif used:
                guess = _guess(leaders[:used], v)
                best = int(np.argmax(guess))
                near = np.flatnonzero(guess >= LINK_FROM).tolist()
                if guess[best] >= CLOSE_FROM:  # all that are linked through d are linked to one of these
                    out.append((ids[best], d, None, None, None))
                    out += [(ids[best], ids[k], None, None, None) for k in near if forest.join(best, k)]
                    continue
                me = forest.add()
                out += [(ids[k], d, None, None, None) for k in near if forest.join(k, me)]
            if not used:
                forest.add()
            if used == len(leaders):
                leaders = np.concatenate([leaders, np.empty_like(leaders)])
            leaders[used] = v
            used += 1
            ids.append(d)
        if out:
            yield rows()
    done()
    if out:
        yield rows()


def _meet_across(batches):
    """Links between the leaders of two parts of a place; rows sorted by place, l, r and part."""
    task, held, right = None, [], []

    def links():
        if not held or not right:
            return
        forest, found = Forest(), []
        for _ in range(len(held) + len(right)):
            forest.add()
        others = np.stack([np.frombuffer(m, np.uint8) for _, m in right])
        for i, (d, m) in enumerate(held):
            near = np.flatnonzero(_guess(others, np.frombuffer(m, np.uint8)) >= LINK_ACROSS).tolist()
            found += [(d, right[k][0]) for k in near if forest.join(i, len(held) + k)]
        if found:
            a = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    for batch in batches:
        for p, x, y, part, d, m in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (p, x, y) != task:
                yield from links()
                task, held, right = (p, x, y), [], []
            (held if part == x else right).append((d, m))
    yield from links()


def candidate_links(reps: DataFrame) -> DataFrame:
    """(a, b): links that join all representatives that may be similar. reps: doc_id, bands, marks; read
    more than once."""
    places = reps.select("doc_id", F.explode("bands").alias("place"))
    shared = materialize(places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = join_hot(places, shared, ["place"], "n").select("place", F.ceil(F.col("n") / PLACE).cast("int").alias("parts"), "doc_id")
    # signatures go only to places of two or more
    met = met.join(reps.select("doc_id", "marks"), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    met = met.select("place", "part", "parts", "doc_id", "marks").repartition("place", "part").sortWithinPartitions("place", "part", "doc_id")
    found = materialize(met.mapInArrow(_meet, "a long, b long, place long, part int, marks binary"))
    links = found.filter("b IS NOT NULL").select("a", "b")
    leaders = found.filter("b IS NULL")
    if leaders.isEmpty():
        return links
    parts = shared.select("place", F.ceil(F.col("n") / PLACE).cast("int").alias("parts")).filter("parts > 1")
    pairs = leaders.join(parts, "place").select("place", "part", "a", "marks", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))).alias("other"))
    pairs = pairs.select("place", F.least("part", "other").alias("l"), F.greatest("part", "other").alias("r"), "part", "a", "marks")
    pairs = pairs.repartition("place", "l", "r").sortWithinPartitions("place", "l", "r", "part")
    return links.unionByName(pairs.mapInArrow(_meet_across, "a long, b long"))


def _overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, from the n-grams that stand in more than one set."""
    flat = np.concatenate([*sets_a, *sets_b])
    _, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    useful = np.cumsum(counts > 1) - 1
    owner = np.repeat(np.arange(len(sets_a) + len(sets_b)), [len(s) for s in (*sets_a, *sets_b)])
    keep = counts[codes] > 1
    codes, owner = useful[codes[keep]], owner[keep]
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, 8192):
        a, b = np.searchsorted(codes, [low, low + 8192])
        hit = np.zeros((len(sets_a) + len(sets_b), 8192), np.float32)
        hit[owner[a:b], codes[a:b] - low] = 1
        out += hit[: len(sets_a)] @ hit[len(sets_a) :].T
    return out


def _verify_task(rows: list[tuple], n: int, threshold: float, hood: int, left: int, right: int):
    """Links of one pair of blocks: (doc_id, links) and spanning links (a, b)."""
    sets = gram_sets([r[2] for r in rows], n)[0]
    one = [i for i, r in enumerate(rows) if r[1] == left]
    two = [i for i, r in enumerate(rows) if r[1] == right] if left != right else one
    sizes = np.array([len(s) for s in sets], np.float64)
    copies = np.array([r[3] for r in rows], np.int64)
    both = _overlaps([sets[i] for i in one], [sets[i] for i in two]).astype(np.float64)
    similar = both >= threshold * (sizes[one][:, None] + sizes[two][None, :] - both) - 1e-9
    if left == right:
        np.fill_diagonal(similar, False)
    links = [(rows[i][0], int(x), None) for i, x in zip(one, similar @ copies[two], strict=True) if x]
    if left != right:
        links += [(rows[i][0], int(x), None) for i, x in zip(two, copies[one] @ similar, strict=True) if x]
    forest = Forest()
    for _ in rows:
        forest.add()
    for i, j in zip(*np.nonzero(similar), strict=True):
        if forest.join(one[i], two[j]):
            links.append((rows[one[i]][0], 0, rows[two[j]][0]))
    return links


def _verify(n: int, threshold: float):
    def run(batches):
        task, rows = None, []

        def done():
            if len(rows) > 1:
                found = _verify_task(rows, n, threshold, *task)
                if found:
                    yield pa.RecordBatch.from_pylist([{"doc_id": a, "links": x, "other": b} for a, x, b in found], pa.schema([("doc_id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]))

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for hood, left, right, block, doc, texts, copies in zip(*cols, strict=True):
                if task != (hood, left, right):
                    yield from done()
                    task, rows = (hood, left, right), []
                rows.append((doc, block, texts, copies))
        yield from done()

    return run


def similar_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, to: str | None = None) -> DataFrame:
    """docs with `to` (`similar`, with underscores before it where docs has one): struct of class_id and
    n_links. Needs doc_id and text."""
    bounded_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    whole = whole_documents(docs)
    signed = materialize(signatures(whole, bands, rows, n))
    same = materialize(signed.groupBy("words_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = materialize(signed.drop("words_key").join(same.select(F.col("rep").alias("doc_id"), "copies"), "doc_id"))
    hoods = connected_components(candidate_links(reps))

    # number the members of each neighbourhood and deal them to blocks
    members = materialize(hoods.join(reps.select(F.col("doc_id").alias("node"), "copies"), "node"))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = join_hot(members, sizes, ["root"], "n").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = materialize(members.select("root", "node", "copies", "blocks", "block"))
    held = whole.withColumnRenamed("doc_id", "node").join(members.hint("shuffle_hash"), "node")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    held = held.select("root", "block", "node", "texts", "copies", F.explode(others).alias("other"))
    held = held.select("root", F.least("block", "other").alias("l"), F.greatest("block", "other").alias("r"), "block", "node", "texts", "copies")
    held = held.repartition("root", "l", "r").sortWithinPartitions("root", "l", "r", "node")
    found = materialize(held.mapInArrow(_verify(n, threshold), "doc_id long, links long, other long"))

    links = found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("other IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("other").alias("b")))
    same = materialize(same.join(links, "rep", "left").join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left"))
    result = join_hot(signed.select("doc_id", "words_key"), same, ["words_key"], "copies")
    result = result.select(
        "doc_id",
        F.coalesce("root", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    own, name = fresh_name(docs, "own"), fresh_name(docs, "found")
    result = result.select(F.col("doc_id").alias(own), F.struct("class_id", "n_links").alias(name))
    out = docs.join(result.hint("shuffle_hash"), F.col("doc_id") == F.col(own), "left")
    similar = F.struct(F.coalesce(F.col(f"{name}.class_id"), F.col("doc_id")).alias("class_id"), F.coalesce(F.col(f"{name}.n_links"), F.lit(0)).alias("n_links"))
    return out.select(*[docs[c] for c in docs.columns], similar.alias(to or result_name(docs, "similar")))


def classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id, n_links."""
    return similar_documents(docs.select("doc_id", "text")).select("doc_id", "similar.class_id", "similar.n_links")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT d.doc_id, (SELECT min(seen) FROM r WHERE node = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links
FROM documents d
"""
