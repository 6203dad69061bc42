"""URL filter: rules as a sorted array of 64-bit digests, memory-mapped and probed by binary search.

A rule is a host and the beginning of a path; it fits its host and all subdomains. Its key is the
xxhash64 of host and path. For each url the keys of all pairs (suffix of the host at a label, beginning
of the path, both of a length that some rule has) are looked up; a hit counts only if the stored full
string is the same, so collisions do no harm. Of the rules that fit, the longest wins (of equal
lengths, the one with the longer host).

The index file is written to the shared folder and fetched once by each executor, which maps it. Its
size is that of the rule list, checked against MAX_INDEX_BYTES; it doesn't grow with the pages.

Defined results: null urls and urls without `://` have empty host and path and fit no rule; urls
that fit none get `default`; a url is probed by as many keys as the rules have lengths, so one of many
labels or megabytes costs no more; repeated rules count once, block before allow; repeated rows are
judged alike; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, fresh_name, put_file, result_name

MAX_INDEX_BYTES = 1 << 30
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    has = F.contains(F.coalesce(url, F.lit("")), F.lit("://"))
    host = F.when(has, F.translate(F.regexp_extract(url, parts, 1), ASCII_UPPER, ASCII_LOWER)).otherwise("")
    return host, F.when(has, F.regexp_extract(url, parts, 2)).otherwise("")


def build_index(rules: list[tuple[str, str, str]]) -> bytes:
    """Sorted keys, then per key: verdict, offset of the string; then the strings.

    Layout: n and size of strings (2 x i8), host lengths and path lengths (for both: count i8, then i8
    each), keys (u8 x n), offsets (i8 x (n + 1)), verdicts (u1 x n, 1 is block), strings: host, NUL, path.
    """
    chosen: dict[bytes, int] = {}
    for verdict, host, path in rules:
        text = host.encode() + b"\0" + path.encode()
        chosen[text] = max(chosen.get(text, 0), int(verdict == "block"))
    keyed = sorted((xxhash.xxh64_intdigest(t), t) for t in chosen)
    hosts, paths = (sorted({len(t.split(b"\0", 1)[i].decode()) for t in chosen}) for i in (0, 1))
    texts = [t for _, t in keyed]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<i8")
    out = b"".join(
        [
            np.array([len(texts), offsets[-1], len(hosts), *hosts, len(paths), *paths], "<i8").tobytes(),
            np.array([k for k, _ in keyed], "<u8").tobytes(),
            offsets.tobytes(),
            np.array([chosen[t] for t in texts], "u1").tobytes(),
            b"".join(texts),
        ]
    )
    if len(out) > MAX_INDEX_BYTES:
        raise ValueError(f"the rule index has {len(out)} bytes; the bound is {MAX_INDEX_BYTES}")
    return out


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        raw = np.memmap(path, "u1", "r")
        n, size, k = raw[:24].view("<i8").tolist()
        at = 24 + 8 * k
        self.host_lengths = raw[24:at].view("<i8").tolist()
        k = int(raw[at : at + 8].view("<i8")[0])
        self.path_lengths = raw[at + 8 : at + 8 + 8 * k].view("<i8").tolist()
        at += 8 + 8 * k
        self.keys = raw[at : at + 8 * n].view("<u8")
        self.offsets = raw[at + 8 * n : at + 16 * n + 8].view("<i8")
        self.block = raw[at + 16 * n + 8 : at + 17 * n + 8]
        self.texts = raw[at + 17 * n + 8 : at + 17 * n + 8 + size]

    def match(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[bool | None]]:
        """Per url the rule that wins and whether it blocks, or None."""
        owner, texts, keys = [], [], []
        digest = xxhash.xxh64_intdigest
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            n = len(host)
            ends = [host[n - k :] for k in self.host_lengths if 0 < k < n and host[n - k - 1] == "." or k == n > 0]
            for start in [path[:k] for k in self.path_lengths if k <= len(path)] if ends else ():
                for end in ends:
                    text = f"{end}\0{start}".encode()
                    owner.append(i)
                    texts.append(text)
                    keys.append(digest(text))
        rules: list[str | None] = [None] * len(hosts)
        blocks: list[bool | None] = [None] * len(hosts)
        best = [(-1, -1)] * len(hosts)
        if not keys or not len(self.keys):
            return rules, blocks
        probe = np.array(keys, "<u8")
        left, right = np.searchsorted(self.keys, probe), np.searchsorted(self.keys, probe, "right")
        for j in np.flatnonzero(left < right):
            for k in range(left[j], right[j]):  # more than one only where digests collide
                a, b = self.offsets[k], self.offsets[k + 1]
                if self.texts[a:b].tobytes() == texts[j]:
                    host, path = texts[j].decode().split("\0", 1)
                    rank, i = (len(host) + len(path), len(host)), owner[j]
                    if rank > best[i]:
                        best[i], rules[i], blocks[i] = rank, host + path, bool(self.block[k])
        return rules, blocks


_OPEN: dict[str, Index] = {}


def _index(name: str) -> Index:
    if name not in _OPEN:
        _OPEN[name] = Index(SparkFiles.get(name))
    return _OPEN[name]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", to: str | None = None) -> DataFrame:
    """pages with `to` (`judged`, with underscores before it where pages has one): struct of host, path,
    rule and verdict of their urls."""
    bounded_batches(pages.sparkSession)
    data = build_index(rules)
    name = f"rules-{hashlib.sha256(data).hexdigest()[:24]}.idx"
    sc = pages.sparkSession.sparkContext
    path_of_rules = put_file(pages.sparkSession, name, data)  # again, if somebody has cleared the folder
    if not any(str(f).endswith(name) for f in sc.listFiles):
        sc.addFile(path_of_rules)

    @F.arrow_udf("struct<rule: string, block: boolean>")
    def probe(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        rule, block = _index(name).match(hosts.to_pylist(), paths.to_pylist())
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(block, pa.bool_())], ["rule", "block"])

    host, path = split_url(F.col(url).cast("string"))
    parts, found = fresh_name(pages, "parts"), fresh_name(pages, "found")
    out = pages.withColumn(parts, F.struct(host.alias("host"), path.alias("path")))
    out = out.withColumn(found, probe(f"{parts}.host", f"{parts}.path"))
    verdict = F.when(F.col(f"{found}.block"), "block").when(~F.col(f"{found}.block"), "allow").otherwise(F.lit(default))
    judged = F.struct(f"{parts}.host", f"{parts}.path", f"{found}.rule", verdict.alias("verdict"))
    return out.select(*[out[c] for c in pages.columns], judged.alias(to or result_name(pages, "judged")))


def verdicts(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), RULES).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']), {'h': '', 'p': ''}) AS u FROM pages),
h AS (
  SELECT page_id, translate(coalesce(u.h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(u.p, '') AS path FROM p),
r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT h.page_id, arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, (length(r.host || r.path), length(r.host))) AS best
  FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id
"""
