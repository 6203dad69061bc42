"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound from the vectors of its letters,
each rotated by its place, by multiplication; a text is the bundle (sum) of its n-grams, and so is
the prototype of a language. The language whose prototype has the largest cosine with the text wins,
ties going to the smaller name. Since bundling is linear, training counts n-grams per language with
a shuffle of counts and bundles once at the end.

Letters are all of Unicode's: a-z have symbols of their own, other letters share 37 by code point.
Anything else is a gap, and a run of gaps is one.

Bound: at most `max_docs` documents per language are learned from, chosen by a digest of doc_id;
the profile has 64^n counts per language at most. Prediction reads whole texts.

Defined results: `und` with score 0 for null texts, texts without letters, and where nothing could
be learned; documents of null language are not learned from; the score is the cosine, at least 0. Two
unrelated texts have a cosine of about 1 / sqrt(DIM) either way. Very long texts are counted whole;
repeated rows are predicted alike; an empty table gives an empty table. Extra columns pass through; one
that is named `to` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, kept

N = 3
DIM = 1024
SYMBOLS = 64
MAX_DOCS = 20_000
SEED = 7
#: Vectors of n-grams that a worker keeps; others are bound anew.
CACHE_ROWS = 8_192

_SYMBOL_OF: np.ndarray | None = None


def symbols(text: str) -> np.ndarray:
    """The text's letters as symbols, with a gap (0) at both ends and for each run between."""
    global _SYMBOL_OF
    if _SYMBOL_OF is None:
        table = np.zeros(0x110000, np.uint8)
        letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        table[letters] = 27 + letters % (SYMBOLS - 27)
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _SYMBOL_OF = table
    s = _SYMBOL_OF[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    s = np.concatenate([[0], s, [0]]).astype(np.int64)
    return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as numbers, and how often each stands in the text."""
    s = symbols(text)
    if len(s) < N:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = sum(s[i : len(s) - N + 1 + i] * SYMBOLS ** (N - 1 - i) for i in range(N))
    return np.unique(code, return_counts=True)


class Space:
    """Letter vectors and the n-gram vectors bound from them."""

    def __init__(self, dim: int, seed: int):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))
        self.turned = [np.roll(letters, N - 1 - i, axis=1) for i in range(N)]
        self.place = np.full(SYMBOLS**N, -1, np.int32)
        self.rows = np.zeros((CACHE_ROWS, dim), np.float32)
        self.used = 0

    def bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.rows.shape[1]), np.int8)
        for i, table in enumerate(self.turned):
            out *= table[codes // SYMBOLS ** (N - 1 - i) % SYMBOLS]
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        new = codes[self.place[codes] < 0][: CACHE_ROWS - self.used]
        if len(new):
            self.rows[self.used : self.used + len(new)] = self.bind(new)
            self.place[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        at = self.place[codes]
        known = at >= 0
        weights = counts.astype(np.float32)
        out = np.zeros(self.rows.shape[1], np.float32)
        for some, vectors in ((np.flatnonzero(known), lambda part: self.rows[at[part]]), (np.flatnonzero(~known), lambda part: self.bind(codes[part]).astype(np.float32))):
            for i in range(0, len(some), 1024):  # a few MB at a time, however long the text
                part = some[i : i + 1024]
                out += weights[part] @ vectors(part)
        return out


def _space(dim: int, seed: int) -> Space:
    return kept(("letters", dim, seed), lambda: Space(dim, seed))


@dataclass
class Profiles:
    langs: list[str]
    prototypes: np.ndarray
    dim: int = DIM
    seed: int = SEED

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        codes, counts = ngram_counts(text)
        if not codes.any():
            return "und", 0.0
        v = _space(self.dim, self.seed).bundle(codes, counts).astype(np.float64)
        cos = self.prototypes @ v / max(float(np.sqrt(v @ v)), 1e-12)
        best = int(np.argmax(cos))
        return self.langs[best], float(min(1.0, max(0.0, cos[best])))


def learnable(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def train(docs: DataFrame, max_docs: int = MAX_DOCS, dim: int = DIM, seed: int = SEED) -> Profiles:
    """Profiles from text and lang of docs (doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles([], np.zeros((0, dim)), dim, seed)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, max_docs / n)))])
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / (1 << 30)
    rows = rows.filter(place < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in totals:
                    totals[lang] = np.zeros(SYMBOLS**N, np.int64)
                codes, counts = ngram_counts(text)
                totals[lang][codes] += counts
        for lang, total in totals.items():
            codes = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(total[codes])], ["lang", "code", "n"])

    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    space, langs, prototypes = _space(dim, seed), sorted(sizes), []
    for lang in langs:
        part = found[found["lang"] == lang]
        v = space.bundle(part["code"].to_numpy(np.int64), part["n"].to_numpy(np.float64)).astype(np.float64)
        prototypes.append(v / max(float(np.sqrt(v @ v)), 1e-12))
    return Profiles(langs, np.array(prototypes), dim, seed)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", to: str = "language") -> DataFrame:
    """docs with a struct of lang and score."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [profiles.predict(x) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    return docs.withColumn(to, predict(F.col(text).cast("string")))


def predictions(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    profiles = train(docs.filter(learnable(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
