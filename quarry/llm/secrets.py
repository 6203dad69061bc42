"""Secret scans: fixed patterns, and zstandard novelty of strings in a sensitive context.

The patterns give spans of the kinds assign, access and hex. The method adds spans of the kind novel:

* a candidate is a run of LEAST_NOVEL or more token characters, with letters and digits among them, that
  begins within REACH code points after a sensitive word, on its line, and meets no span of a pattern;
* its novelty is its marginal size: how many more bytes zstandard makes of its surroundings with it than
  without, in shares of its own length. The compressor is primed with a dictionary of the identifiers that
  the corpus uses most. The surroundings are the WIDTH code points before it, those after it, and both, all
  without copies of the candidate itself; the middle one of the three sizes counts;
* a candidate of novelty NOVEL or more can't be made of what stands around it or of common identifiers,
  and is reported.

The identifiers are counted over all documents (runs of 4 to 24 ASCII letters, in two occurrences at least)
and the most frequent fill the dictionary, whose size is a parameter; only these reach the driver. Every
text is scanned whole by the task that reads it, in time that grows with its length.

Defined results: a null or empty text has no spans; rows that repeat a document are scanned each; an empty
table gives an empty table. Spans count code points, end exclusive, and are sorted by start, then by kind in
the order of KINDS. Extra columns pass through; one that is named `to` is replaced. The session's batches for
Python workers are bounded (common.bounded_batches).
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, materialize

#: Kinds of spans, in their order.
KINDS = ("assign", "access", "hex", "novel")
#: Fixed values of the contract. Matches whose secret is shorter than LEAST_ASSIGN are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6

#: Words after which a string may be a secret, and what may be one.
SENSITIVE = re.compile(
    r"(?<![A-Za-z])(?:passw(?:or)?d|passphrase|pwd|secret|token|credentials?|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|encryption[\x20_-]?key|auth|authorization|bearer|signature|session|cookie|salt)(?![A-Za-z])",
    re.IGNORECASE | re.ASCII,
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
REACH, WIDTH, LEAST_NOVEL, LEAST_LETTERS = 64, 128, 16, 4
#: Share of a candidate's length that it adds to what its surroundings compress to; compression level.
NOVEL, LEVEL = 0.85, 12
#: Bytes of the dictionary of identifiers.
DICTIONARY = 1 << 16


def identifiers(docs: DataFrame, size: int = DICTIONARY) -> bytes:
    """The most frequent identifiers of docs (text), the most frequent last, as a dictionary of `size`
    bytes at most. Frequencies of like size (16 levels for each doubling) go in together or not at all."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,24}"), F.lit(0))).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    words = materialize(words.withColumn("level", F.floor(16 * F.log2("n")).cast("int")))
    levels = words.groupBy("level").agg(F.sum(F.length("word") + 1).alias("bytes")).orderBy(F.desc("level"))
    least, left = None, size
    for r in levels.collect():  # under a thousand rows
        left -= r["bytes"]
        if left < 0:
            break
        least = r["level"]
    if least is None:
        return b""
    top = sorted(words.filter(F.col("level") >= least).select("n", "word").collect(), key=lambda r: (r["n"], r["word"]))
    return " ".join(r["word"] for r in top).encode()


_PRIMED: dict[bytes, zstandard.ZstdCompressor] = {}


def _compressor(words: bytes) -> zstandard.ZstdCompressor:
    """One for a worker and dictionary."""
    if words not in _PRIMED:
        more = {}
        if len(words) >= 8:
            more["dict_data"] = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            more["dict_data"].precompute_compress(level=LEVEL)
        _PRIMED.clear()
        _PRIMED[words] = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False, **more)
    return _PRIMED[words]


def novelty(before: str, candidate: str, after: str, words: bytes = b"") -> float:
    """Marginal bytes of a candidate among its surroundings, in shares of its length."""
    z = _compressor(words)
    data = candidate.encode("utf-8", "replace")
    sizes = []
    for around in (before, after, before + after):
        around = around.replace(candidate, "").encode("utf-8", "replace")
        sizes.append(len(z.compress(around + data)) - len(z.compress(around)))
    return sorted(sizes)[1] / len(data)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, in order."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def novel_spans(text: str, base: list[tuple[int, int, str]], words: bytes = b"") -> list[tuple[int, int, str]]:
    """The spans that the method adds to those of the patterns."""
    out, done, at, covered = [], 0, 0, 0
    for m in SENSITIVE.finditer(text):
        start, stop = m.end(), min(len(text), m.end() + REACH)
        line = text.find("\n", start, stop)
        stop = stop if line < 0 else line
        start = max(start, done)  # candidates of an earlier word aren't judged again
        while start < stop:
            c = CANDIDATE.search(text, start)
            if c is None:
                return out
            if c.start() >= stop:
                break
            a, start = c.start(), c.end()
            b = done = c.end()
            while at < len(base) and base[at][0] < b:  # base spans and candidates both go forward
                covered = max(covered, base[at][1])
                at += 1
            run = c.group()
            letters = sum(x.isalpha() for x in run)
            if b - a < LEAST_NOVEL or covered > a or letters < LEAST_LETTERS or not any(x.isdigit() for x in run):
                continue
            if novelty(text[max(0, a - WIDTH) : a], run, text[b : b + WIDTH], words) >= NOVEL:
                out.append((a, b, "novel"))
    return out


def spans(text: str | None, words: bytes = b"") -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind."""
    base = base_spans(text or "")
    return sorted(base + novel_spans(text or "", base, words), key=lambda s: (s[0], KINDS.index(s[2])))


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, words: bytes = b"", text: str = "text", to: str = "secrets") -> DataFrame:
    """docs with `to`: an array of struct<kind, start, end>. words: a dictionary from identifiers()."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<struct<kind: string, start: long, end: long>>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in spans(t.as_py(), words)] for t in texts], _KIND)

    return docs.withColumn(to, find(F.col(text).cast("string")))


def _written(some: Column) -> Column:
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """Per document: doc_id, how many spans each pattern gives, the digest of these, and all spans."""
    found = scan(docs.select("doc_id", "text"), identifiers(docs, size)).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _written(F.filter("secrets", lambda s: s["kind"] != KINDS[-1]))
    return found.select("doc_id", *[count(k) for k in KINDS[:-1]], F.sha2(base.cast("binary"), 256).alias("base_sha256"), _written(F.col("secrets")).alias("spans"))
