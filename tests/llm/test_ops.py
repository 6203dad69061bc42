"""Small cases of each training-data operator: nulls, empties, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import time
from collections import defaultdict
from math import comb

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import ann, blocks, bpe, chat, common, components, htmlextract, htmltrees, langid, linededup, maxscore, mixing, ngramjoin, queries, urlfilter
from quarry.llm.common import table
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or {}).get(i), (sources or {}).get(i), None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ---- mixing


def test_hypergeometric_inversion(spark):
    rng = random.Random(0)
    rows = []
    for _ in range(150):
        n = rng.choice([1, 5, 40, 300])
        rows.append((rng.random(), n, rng.randint(0, n), rng.randint(0, n)))
    d = spark.createDataFrame(rows, "u double, n long, k long, d long")
    for u, n, k, d_, x in d.select("*", mixing.hypergeometric(F.col("u"), F.col("n"), F.col("k"), F.col("d"))).collect():
        low, high = max(0, d_ - (n - k)), min(d_, k)
        p = lambda i: comb(k, i) * comb(n - k, d_ - i) / comb(n, d_)  # noqa: B023, E731
        mode = min(max(math.floor((d_ + 1) * (k + 1) / (n + 2)), low), high)
        order, up, down = [mode], mode, mode
        while up < high or down > low:
            if up < high:
                up += 1
                order.append(up)
            if down > low:
                down -= 1
                order.append(down)
        rest = u
        for want in order:
            rest -= p(want)
            if rest < 0:
                break
        assert x == want


def test_mix_reaches_targets_and_deals_disjoint_copies(spark):
    docs = table(spark, SMALL.replace("0.001", "0.01"), "documents")
    rows = mixing.mix(docs, shard_words=100_000).select("doc_id", "source", "mix.*").collect()
    per = defaultdict(lambda: [0, 0.0])
    for r in rows:
        assert len(r.copies) <= 3 and all(s is not None for s in r.copies)
        per[r.source][0] += r["size"] * len(r.copies)
        per[r.source][1] = r.target
    total = sum(r["size"] for r in rows)
    assert abs(sum(t for _, t in per.values()) - total) < 1e-3
    assert all(abs(taken - target) <= max(30, 0.01 * target) for taken, target in per.values())
    again = mixing.mix(docs, shard_words=100_000).select("doc_id", "mix.*").collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)
    assert mixing.mixed(docs, shard_words=100_000).count() == sum(len(r.copies) for r in rows)


def test_mix_small_cases(spark):
    assert mixing.word_totals(docs_of(spark, []).limit(0)).count() == 0
    d = docs_of(spark, [None, "", "a b", "a b c d", "x"], {0: "s", 1: "s", 2: "t", 3: None, 4: None})
    d = d.withColumn("mix_shard", F.lit("x")).withColumn("size", F.lit("y")).withColumn("rest", F.lit(1))
    out = {r.doc_id: r for r in mixing.word_totals(d).collect()}
    assert out[0]["size"] == 0 and out[0].target == 0 and out[0].taken == 0
    assert out[3].source_size == 5 and all(r.taken <= 3 * r["size"] for r in out.values())
    assert set(mixing.mix(d).columns) == {*d.columns, "mix"}
    one = mixing.word_totals(docs_of(spark, ["a b c"], {0: "s"})).first()
    assert (one.target, one.taken) == (3.0, 3)
    twice = docs_of(spark, ["a b c"], {0: "s"})
    assert [r.taken for r in mixing.word_totals(twice.unionByName(twice)).collect()] == [3, 3]


def test_mix_of_small_sources_comes_near_the_targets(spark):
    per = defaultdict(lambda: [0, 0.0])
    docs = table(spark, SMALL, "documents")
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in mixing.word_totals(docs).collect():
        per[source[r.doc_id]][0] += r.taken
        per[source[r.doc_id]][1] = r.target
    assert len(per) == 20 and all(abs(taken - target) <= 0.02 * target for taken, target in per.values())


def test_nearest_subset_is_the_best_of_all(spark):
    rng = random.Random(2)
    rows = [(i, [(k, rng.choice([0, 1, 5, 40, 900])) for k in range(rng.randint(1, 11))], rng.random() * 900) for i in range(40)]
    d = spark.createDataFrame(rows, "i long, units array<struct<key: long, size: long>>, gap double")
    for i, units, gap, (end, fits) in d.select("*", mixing._nearest_subset(F.col("units"), F.col("gap"))).collect():
        taken = sum(size for key, size in units if key < end or key in fits)
        want = min(abs(sum(u[1] for j, u in enumerate(units) if m >> j & 1) - gap) for m in range(1 << len(units)))
        assert abs(taken - gap) == pytest.approx(want), i


def test_mixed_keeps_columns_of_any_name(spark):
    d = docs_of(spark, ["a b"] * 30, {i: f"s{i % 3}" for i in range(30)})
    d = d.select("*", F.lit(1).alias("mix"), F.lit(2).alias("mix_shard"), F.lit(3).alias("mix_copy"), F.lit(4).alias("_copy"), F.lit(5).alias("copies"))
    out = mixing.mixed(d, shard_words=8)
    assert out.columns == d.columns and {tuple(r)[5:] for r in out.collect()} == {(1, 2, 3, 4, 5)}
    assert mixing.mix(d).columns == [*d.columns, "_mix"]


# ---- vectors


def brute(rows, query, k, score, largest):
    found = sorted(((score(query, v), i) for i, v in rows if i != query[0]), key=lambda x: (-x[0] if largest else x[0], x[1]))
    return found[:k]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, query_id long").withColumn("score", F.lit("clash"))


def test_nearest_recall_and_scores(spark):
    v = table(spark, SMALL, "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in v.collect()]
    got = defaultdict(list)
    for r in sorted(ann.neighbours(v).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.score, r.vec_id))
    hits = total = 0
    for q in rows:
        if q[0] % 100 == 0:
            want = brute(rows, q, 10, lambda a, b: float(np.sqrt(((a[1] - b) ** 2).sum())), False)
            hits += len({i for _, i in want} & {i for _, i in got[q[0]]})
            total += len(want)
            assert all(s == pytest.approx(float(np.sqrt(((q[1] - dict(rows)[i]) ** 2).sum()))) for s, i in got[q[0]])
    assert hits / total >= 0.95


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 0, 1), (1, [1.0, 0.0], 0, 1), (2, [1.0, 0.0], 0, 1), (3, [0.0, 0.0], 0, 1), (4, None, 0, 1), (5, [float("nan"), 1.0], 0, 1), (6, [None, 1.0], 0, 1), (7, [], 0, 1), (100, [0.9, 0.1], 0, 1), (200, None, 0, 1)]
    out = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(vectors_of(spark, rows)).collect())
    assert out == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.neighbours(vectors_of(spark, rows).limit(0)).count() == 0


def test_nearest_among_near_copies(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[::3] = x[0] + rng.normal(0, 0.01, (1000, 64))
    rows = [(i, [float(c) for c in v.astype(np.float32)], 0, 1) for i, v in enumerate(x)]
    whole = [(i, np.array(v)) for i, v, *_ in rows]
    got = defaultdict(list)
    for r in sorted(ann.neighbours(vectors_of(spark, rows)).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    for q in whole[::100]:
        want = brute(whole, q, 10, lambda a, b: float(np.sqrt(((a[1] - b) ** 2).sum())), False)
        assert got[q[0]] == [i for _, i in want]


def test_searches_in_many_blocks_and_slices(spark, monkeypatch):
    v = table(spark, SMALL, "embeddings").limit(300)
    rows = lambda d: sorted(map(tuple, d.collect()))
    want = rows(ann.nearest(v, F.col("vec_id") % 7 == 0, 3)), rows(maxscore.top_k(v, F.col("vec_id") % 7 == 0, 3))
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 9)
    monkeypatch.setattr(blocks, "SLICE", 40)
    assert rows(ann.nearest(v, F.col("vec_id") % 7 == 0, 3)) == want[0]
    assert rows(maxscore.top_k(v, F.col("vec_id") % 7 == 0, 3)) == want[1]


def test_rows_of_one_vec_id_are_one_query_and_candidates_each(spark):
    rows = [(0, [1.0, 0.0], 0, 1), (0, [1.0, 0.0], 0, 1), (0, [2.0, 0.0], 0, 1), (3, [1.0, 0.5], 0, 1), (3, [1.0, 0.25], 0, 1), (100, [1.0, 1.0], 0, 1)]
    near = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(vectors_of(spark, rows)).collect())
    assert [x[:3] for x in near] == [(0, 1, 3), (0, 2, 3), (0, 3, 100), (100, 1, 3), (100, 2, 3), (100, 3, 0), (100, 4, 0), (100, 5, 0)]
    assert [x[3] for x in near[:3]] == [0.25, 0.5, 1.0]
    top = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.matches(vectors_of(spark, rows)).collect())
    assert top[:3] == [(0, 1, 3, 65536), (0, 2, 3, 65536), (0, 3, 100, 65536)]
    assert [x[2] for x in top[3:]] == [0, 3, 3, 0, 0]
    assert maxscore.matches(vectors_of(spark, rows).limit(0)).count() == 0


def test_codes_are_packed_two_to_a_byte():
    import pyarrow as pa

    codes = np.random.default_rng(0).integers(0, 16, (5, 7)).astype(np.uint8)
    packed = ann.pack(codes)
    assert packed.shape == (5, 4) and (ann.unpack(pa.array([x.tobytes() for x in packed], pa.binary()), 7) == codes).all()


def test_parallel_error_costs_more():
    x = np.random.default_rng(0).normal(size=(400, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]

    def parallel_error(weight):
        old = ann.parallel_weight
        try:
            ann.parallel_weight = lambda *_: weight
            m = ann.fit(x)
        finally:
            ann.parallel_weight = old
        codes = m.encode(x).astype(int)
        back = np.take_along_axis(m.books[None], codes[:, :, None, None], 2).reshape(len(x), -1)
        return (((x - back) * x).sum(1) ** 2).mean()

    assert parallel_error(8.0) < 0.7 * parallel_error(1.0)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8).astype(np.float32)], 0, 1) for i in range(300)]
    rows += [(300 + i, rows[7][1], 0, 1) for i in range(20)] + [(400, None, 0, 1), (401, [float("inf")] * 8, 0, 1), (402, [0.0] * 8, 0, 1), (450, [-0.5] * 8, 0, 1)]
    whole = [(i, np.floor(256 * np.array(v, np.float64))) for i, v, *_ in rows if v is not None and np.isfinite(v).all()]
    got = defaultdict(list)
    for r in sorted(maxscore.matches(vectors_of(spark, rows)).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.score, r.vec_id))
    for q in whole:
        if q[0] % 50 == 0:
            assert got[q[0]] == brute(whole, q, 5, lambda a, b: int(a[1] @ b), True)


@pytest.mark.parametrize("share", [1.0, 0.3, 0.05])
def test_maxscore_shard_with_a_floor(share):
    rng = np.random.default_rng(5)
    x = rng.integers(-60, 60, (500, 12)) * (rng.random((500, 12)) < share)
    q = rng.integers(-60, 60, (50, 12)) * (rng.random((50, 12)) < max(share, 0.3))
    full = q @ x.T
    floor = np.sort(full, 1)[:, -5].astype(float)
    for kind in (np.float64, np.int64):
        found = maxscore.Shard(x, kind).search(q.astype(kind), floor)
        assert set(zip(*np.nonzero(full >= floor[:, None]), strict=True)) <= set(zip(*found[:2], strict=True))
        assert (full[found[0], found[1]] == found[2]).all()
        everything = maxscore.Shard(x, kind).search(q.astype(kind), np.full(50, -np.inf))
        assert len(everything[0]) == full.size


def test_top_k_of_sparse_vectors_is_exact(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((400, 40)) < 0.06, rng.normal(0, 1, (400, 40)), 0).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0, 1) for i, v in enumerate(x)]
    whole = [(i, np.floor(256 * np.array(v, np.float64))) for i, v, *_ in rows]
    got = defaultdict(list)
    for r in sorted(maxscore.matches(vectors_of(spark, rows)).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.score, r.vec_id))
    for q in whole[::50]:
        assert got[q[0]] == brute(whole, q, 5, lambda a, b: int(a[1] @ b), True)


# ---- language


def test_language_held_out_accuracy(spark):
    docs = table(spark, SMALL, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in queries.op3_language(spark, SMALL).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_small_cases(spark):
    d = docs_of(spark, ["the cat and the dog", "der hund und die katze", None, "", "123 !?", "chien"], langs={0: "en", 1: "de"}).withColumn("language", F.lit("x"))
    p = langid.train(d)
    out = {r.doc_id: r.found for r in langid.identify(d, p, to="found").collect()}
    assert out[0].lang == "en" and out[1].lang == "de"
    assert all(out[i].lang == "und" and out[i].score == 0 for i in (2, 3, 4))
    empty = langid.train(d.limit(0))
    assert langid.identify(d, empty, to="found").first().found.lang == "und"


def test_bundle_is_the_sum_of_bound_vectors():
    space = langid.Space(64, 3)
    codes, counts = langid.ngram_counts("aab aab")
    want = sum(n * space.bind(np.array([c]))[0].astype(float) for c, n in zip(codes, counts, strict=True))
    assert np.allclose(space.bundle(codes, counts), want)


def test_language_equals_plain_calculation(spark):
    """Every letter of every n-gram multiplied and added one by one, in few dimensions."""
    docs = table(spark, SMALL, "documents").filter("doc_id < 60")
    dim = 96
    letters = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.SYMBOLS, dim)).astype(float)

    def symbol(c):
        return 0 if not c.isalpha() else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37

    def bundle(text):
        s = [0]
        for c in [*(text or "").lower(), " "]:
            if symbol(c) or s[-1]:
                s.append(symbol(c))
        total = np.zeros(dim)
        for i in range(len(s) - 2):
            total += np.roll(letters[s[i]], 2) * np.roll(letters[s[i + 1]], 1) * letters[s[i + 2]]
        return total

    rows = docs.collect()
    kinds = sorted({r.lang for r in rows if r.lang})
    prototypes = [sum(bundle(r.text) for r in rows if r.lang == k) for k in kinds]
    found = {r.doc_id: r.found for r in langid.identify(docs, langid.train(docs, dim=dim), to="found").collect()}
    for r in rows:
        v = bundle(r.text)
        cos = [float(p @ v / np.sqrt((p @ p) * (v @ v))) for p in prototypes]
        assert found[r.doc_id].lang == kinds[int(np.argmax(cos))] and found[r.doc_id].score == pytest.approx(max(0, max(cos)), abs=1e-5)


# ---- chat


def test_chat_round_trip_of_odd_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "[INST]</s> &lt; &amp;"), (1, 1, "assistant", "a"), (2, 0, None, None), (2, None, "to]ol[", "x"), (None, 3, "user", "")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = {r.conv_id: r for r in chat.format_conversations(t).collect()}
    read = {r.conv_id: [(x.role, x.text) for x in r.read] for r in chat.format_conversations(t).withColumn("read", chat.read_turns(F.col("formatted"))).collect()}
    assert read[1] == [("user", "[INST]</s> &lt; &amp;"), ("assistant", "a"), ("assistant", "b")]
    assert read[2] == [("", ""), ("to]ol[", "x")] and read[None] == [("user", "")]  # a null turn is the last, as in the SQL
    assert out[1].bad_turn == 3 and out[2].bad_turn == 1 and out[None].bad_turn is None
    for r in out.values():
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.digests(t.limit(0)).count() == 0


def test_chat_long_conversation_in_runs(spark):
    n = 5 * chat.RUN_TURNS + 3
    rows = [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)]
    random.Random(1).shuffle(rows)
    r = chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    rows.sort(key=lambda x: x[1])
    assert r.n_turns == n and r.bad_turn is None
    assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in rows).encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256("".join(b for _, _, a, b in rows if a == "assistant").encode()).hexdigest()


# ---- urls


def test_urls(spark):
    urls = ["https://A.Example.org/es/x", "http://example.org/en/12?q", "http://org/", "http://xorg/", "ftp://x.com/de/?", "http://x.com/fr", None, "no scheme", "http://", "http://example.org#/es/", "a://b://x.org/y"]
    p = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule_id string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.verdicts(p).collect()}
    assert out[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert out[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert out[2][2:] == ("org/", "allow") and out[3][2:] == (None, "allow")
    assert out[4][2:] == ("com/de/", "block") and out[5][2:] == (None, "allow")
    assert out[6] == ("", "", None, "allow") == out[7] and out[8][:2] == ("", "")
    assert out[9][:3] == ("example.org", "", None) and out[10][:2] == ("b:", "//x.org/y")
    assert urlfilter.verdicts(p.limit(0)).count() == 0


def test_urls_of_any_length_and_columns_of_any_name(spark):
    rows = [(1, "http://" + "a." * 500_000 + "example.org/es/" + "x" * 1_000_000, 1), (2, "http://" + "y" * 1_000_000 + "/es/", 2)]
    p = spark.createDataFrame(rows, "page_id long, url string, host long").select("*", F.lit("p").alias("path"), F.lit("r").alias("rule"), F.lit("v").alias("verdict"), F.lit("j").alias("judged"))
    start = time.time()
    out = {r.page_id: r for r in urlfilter.judge(p, urlfilter.RULES, to=None).collect()}
    assert time.time() - start < 20
    assert out[1]._judged.rule == "example.org/es/" and out[2]._judged.rule is None
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict, out[1].judged) == (1, "p", "r", "v", "j")


def test_index_confirms_strings(tmp_path):
    data = bytearray(urlfilter.build_index([("block", "a.b", "/"), ("block", "c.d", "/x")]))
    path = tmp_path / "i"
    path.write_bytes(data)
    index = urlfilter.Index(str(path))
    assert index.match(["q.a.b", "c.d"], ["/1", "/xy"])[1] == [True, True]
    at = bytes(data).index(b"a.b\0")
    data[at] = ord("z")  # the digest still hits, the string doesn't
    path.write_bytes(data)
    assert urlfilter.Index(str(path)).match(["a.b"], ["/"])[0] == [None]


# ---- lines


def brute_lines(texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(urlfilter.ASCII_UPPER, urlfilter.ASCII_LOWER))
    owners = defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            owners[key(x)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(owners[key(x)]) < 2 or min(owners[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


TEXTS = {0: "same line here\nown one is here\nshort", 1: "  SAME line here\t\nshort\nsame line here", 2: "Élan vital no\nélan vital no", 3: None, 4: "", 5: "same line here", 6: "own one is here\nélan vital no"}


def line_docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("lost", F.lit(1)).withColumn("lines_", F.lit(2))


def kept(out):
    return {r.doc_id: (r.lines.n_lines, r.lines.n_dropped, r.text or "") for r in out.collect()}


def test_lines(spark):
    d = line_docs(spark, TEXTS)
    assert kept(linededup.dedup(d)) == brute_lines(TEXTS)
    assert linededup.dedup(d.limit(0)).count() == 0
    again = d.unionByName(d)
    assert kept(linededup.dedup(again)) == brute_lines(TEXTS) and linededup.dedup(again).count() == 2 * len(TEXTS)


def test_lines_insert_and_delete_are_reversible(spark):
    one, two = {k: v for k, v in TEXTS.items() if k < 3}, {k: v for k, v in TEXTS.items() if k >= 3}
    first = linededup.insert(linededup.LineState.empty(spark, 3), line_docs(spark, one))
    both = linededup.insert(first, line_docs(spark, two))
    assert kept(linededup.rewrite(line_docs(spark, TEXTS), both)) == brute_lines(TEXTS)
    back = linededup.delete(both, line_docs(spark, two).select("doc_id"))
    table_of = lambda s: sorted((bytes(r.key), r.refs, r.owner) for r in s.counts.collect())
    assert table_of(back) == table_of(first)
    gone = linededup.delete(both, spark.createDataFrame([(0,)], "doc_id long"))
    rest = {k: v for k, v in TEXTS.items() if k != 0}
    assert kept(linededup.rewrite(line_docs(spark, rest), gone)) == brute_lines(rest)
    keys = {bytes(r.key): r.shard for r in gone.counts.collect()}
    filters = {r.shard: linededup.CuckooFilter.from_bytes(r.bits) for r in gone.filters.collect()}
    assert all(filters[s].contains(np.array([int.from_bytes(k[8:], "little")], "<u8"))[0] for k, s in keys.items())


def test_lines_growth_double_insert_and_exact_counts(spark):
    texts = {i: "\n".join(f"line number {i * 7 + k} of the text" for k in range(10)) for i in range(120)}
    small, large = {k: v for k, v in texts.items() if k < 4}, {k: v for k, v in texts.items() if k >= 4}
    state = linededup.insert(linededup.LineState.empty(spark, 2), line_docs(spark, small))
    state = linededup.insert(state, line_docs(spark, large))  # thirty times as many keys: filters are built anew
    state = linededup.insert(state, line_docs(spark, texts))  # known documents change nothing
    assert kept(linededup.rewrite(line_docs(spark, texts), state)) == brute_lines(texts)
    refs = defaultdict(set)
    for i, t in texts.items():
        for x in t.split("\n"):
            refs[linededup.line_key(x)].add(i)
    assert {bytes(r.key): (r.refs, r.owner) for r in state.shared.collect()} == {k: (len(v), min(v)) for k, v in refs.items() if len(v) > 1}
    assert sum(r["size"] for r in state.filters.collect()) == len(refs) == state.counts.count()
    twice = linededup.insert(linededup.LineState.empty(spark, 2), line_docs(spark, small).unionByName(line_docs(spark, small)))
    assert max(r.refs for r in twice.counts.collect()) == 2


def test_lines_are_looked_up_only_where_a_filter_lets_them_through(spark):
    one, two = {0: "the first line of all"}, {1: "the first line of all"}
    state = linededup.insert(linededup.LineState.empty(spark, 1), line_docs(spark, one))
    assert [r.refs for r in linededup.insert(state, line_docs(spark, two)).shared.collect()] == [2]
    state.filters = linededup.build_filters(state.counts.select("shard", F.unhex(F.lit("00" * 16)).alias("key")))
    assert linededup.insert(state, line_docs(spark, two)).shared.count() == 0


def test_lines_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    texts = {i: "a line that all of them have\nand this one is of " + str(i // 2) for i in range(30)}
    assert kept(linededup.dedup(line_docs(spark, texts))) == brute_lines(texts)
    d = line_docs(spark, texts).withColumn("lines", F.lit("x"))
    assert linededup.dedup(d).columns == [*d.columns, "_lines"]


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000).astype("<u8")
    f = linededup.CuckooFilter.empty(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    other = rng.integers(0, 1 << 63, 20_000).astype("<u8")
    assert f.contains(other).mean() < 0.005
    f.delete(keys[:5000])
    assert f.contains(keys[5000:]).all() and f.contains(keys[:5000]).mean() < 0.01
    small = linededup.CuckooFilter(np.zeros((16, 4), "<u2"))
    assert not small.insert(keys[:500])


# ---- html


def test_html_structure():
    page = "<html><body><nav><a href=x>Home</a></nav><div class=\"cookie-notice\">We use cookies here.</div><article><h1>A &lt;title&gt; &amp; more</h1><p><b>First  part<br>second<p>Next <a href=y>link</a> text goes on for a while with words.</p><script>var x = '<p>no</p>'</script><div class='ad'>Buy this now</div><p>Last words of the text are here.</article><section id='comments'><p>I think this is a very nice article about words and things.</p></section><footer>&copy; me</footer>"
    out = htmlextract.extract_texts([page, None, "", "plain", "<"], htmlextract.trained())
    assert out[0] == "A <title> & more\n\nFirst part second\n\nNext link text goes on for a while with words.\n\nLast words of the text are here."
    assert out[1] == out[2] == ""


_A = "The harbour was rebuilt after the great storm, and its long stone pier has been used by the fishing fleet ever since."
_B = "In the autumn the boats leave before dawn and come back in the afternoon, when the market hall opens for buyers from the inland towns."
_C = "Short closing remark."
HAND_WRITTEN = {
    "blog": f"""<html><body><div id="wrapper"><div id="header"><a href="/">Coast Notes</a><ul class="menu"><li><a href=/a>Home</a><li><a href=/b>About</a></ul></div>
<div class="post-body"><h1>The harbour</h1><p>{_A}</p><p>{_B}</p><blockquote>{_C}</blockquote></div>
<div class="sidebar"><h3>Recent posts</h3><ul><li><a href=1>The old lighthouse and its keeper</a><li><a href=2>Winter ferries</a></ul><h3>About me</h3><p>I write about the coast and its people every other week.</p></div>
<div class="footer">Copyright 2020 Coast Notes. All rights reserved.</div></div></body></html>""",
    "main": f"""<body><header><h1>Daily News</h1><nav><a href=/x>World</a> <a href=/y>Sport</a></nav></header><main><article><header><h2>The harbour</h2><p class="byline">By A. Writer</p></header><p>{_A}</p><aside class="related"><h4>More on this</h4><a href=q>Storm of the century</a></aside><p>{_B}</p><ul><li>First point of note in this list</li><li>Second point of note in this list</li></ul><p>{_C}</p></article></main><footer><p>Contact us at the harbour office. Terms and privacy.</p></footer></body>""",
    "table": f"""<body><table width=100%><tr><td class=nav><a href=1>Index</a><br><a href=2>Search</a></td><td class=content><h1>The harbour</h1><p>{_A}<p>{_B}</td></tr></table><div class=copyright>(c) 1999</div></body>""",
    "cookie": f"""<body><div class="cookie-banner" role="dialog"><p>We use cookies to give you the best experience on our site. By going on you agree to this.</p><button>Accept</button></div><div class="entry-content"><h1>The harbour</h1><p>{_A}</p><div class="ad-slot">Advertisement: buy boats now, cheap offers every day</div><p>{_B}</p></div><div id="comments"><h2>3 comments</h2><div class="comment"><p>I have been there many times and loved the market hall and all the people.</p></div></div></body>""",
    "plain": f"""<html><head><title>x</title></head><body><h1>The harbour</h1><p>{_A}</p><p>{_B}</p></body></html>""",
    "news": f"""<body><div class="top-bar"><span>Sign in</span><form><input><button>Search</button></form></div><section class="story"><h1>The harbour</h1><figure><img src=x><figcaption>The pier at noon in the spring</figcaption></figure><p>{_A}</p><p>{_B}</p><div class="newsletter-signup"><p>Get our newsletter every Sunday morning.</p><form><input type=email><button>Subscribe</button></form></div><p>{_C}</p></section><section class="recommended"><h3>You may also like</h3><article><h4><a href=1>Ten beaches for the summer</a></h4><p>From white sand to black rocks, our pick.</p></article></section></body>""",
    "rightcol": f"""<body><div class="container"><div class="row"><div class="col-8"><h1>The harbour</h1><p>{_A}</p><h2>Autumn</h2><p>{_B}</p></div><div class="col-4 widget-area"><h2>Popular</h2><ul><li><a href=1>Lighthouse</a></li><li><a href=2>Ferries</a></li></ul><h2>Archive</h2><p>2019</p></div></div></div></body>""",
}
MORE = {
    "blog": ["The harbour", _A, _B, _C],
    "main": ["The harbour", _A, _B, "First point of note in this list", "Second point of note in this list", _C],
    "table": ["The harbour", _A, _B],
    "cookie": ["The harbour", _A, _B],
    "plain": ["The harbour", _A, _B],
    "news": ["The harbour", "The pier at noon in the spring", _A, _B, _C],
    "rightcol": ["The harbour", _A, "Autumn", _B],
}


def test_html_of_pages_written_by_hand():
    """Layouts that the generator of the training pages doesn't write."""
    out = htmlextract.extract_texts(list(HAND_WRITTEN.values()), htmlextract.trained())
    assert dict(zip(HAND_WRITTEN, (x.split("\n\n") for x in out), strict=True)) == MORE


def test_html_of_many_end_tags_and_odd_tables(spark):
    start = time.time()
    long = "<article><p>Words of the text that stays here for a while.</p>" + "<b></i></span>" * 20_000 + "</p></li>" * 10_000 + "<div><span>" * 5_000 + "</article>"
    p = spark.createDataFrame([(1, "u", long, 3), (2, "u", None, 3)], "page_id long, url string, html string, main_text long")
    out = {r.page_id: r for r in htmlextract.texts(p).collect()}
    assert time.time() - start < 60 and "Words of the text" in out[1].text and (out[2].text, out[2].n_chars) == ("", 0)
    assert htmlextract.texts(p.limit(0)).count() == 0
    assert htmlextract.extract(p, to="t").columns == [*p.columns, "t"]


def test_html_held_out_pages():
    model, good, n = htmlextract.trained(), 0, 0
    for source in htmlextract.made_up_pages(60, 4242):
        page = htmltrees.parse(source)
        known = [htmlextract._MARK in a or i == 0 for i, a in enumerate(page.attrs)]
        want = set(htmltrees.kept_text(page, known).split("\n\n"))
        page.attrs = [a.replace(htmlextract._MARK, "") for a in page.attrs]
        got = set(htmltrees.kept_text(page, htmltrees.decode(page, model.predict(htmltrees.features(page)))).split("\n\n"))
        good += len(want & got)
        n += len(want | got)
    assert good / n > 0.96


def test_decode_never_keeps_below_a_dropped_element():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = 30
        page = htmltrees.Page(parent=[-1] + [int(rng.integers(0, i)) for i in range(1, n)], tag=["div"] * n, attrs=[""] * n, own_chars=rng.integers(0, 50, n).tolist())
        k = htmltrees.decode(page, rng.normal(size=n))
        assert all(not k[i] or k[page.parent[i]] for i in range(1, n))


def test_html_query_takes_the_article(spark):
    import html

    rows = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    bad = 0
    for r in queries.op8_main_text(spark, SMALL).collect():
        body = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:h1|p)>", body)]
        bad += r.text != "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    assert bad == 0


# ---- n-gram join


def brute_join(texts, n=5, t=0.8):
    def grams(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets = {i: grams(x) for i, x in texts.items()}
    links, up = defaultdict(int), {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (root(i), links[i]) for i in ids}


def join_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    texts = {}
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = word()
            texts[len(texts)] = rng.choice([" ", "\n", "  "]).join(w)
    for x in (None, "", " \t", "one two", "One  two", "one two three four five", "one"):
        texts[len(texts)] = x
    return texts


def test_join_equals_brute_force(spark):
    texts = join_texts()
    d = spark.createDataFrame([(i, t, "c", "n") for i, t in texts.items()], "doc_id long, text string, class_id string, found string")
    out = {r.doc_id: tuple(r.similar) for r in ngramjoin.similar_documents(d).collect()}
    assert out == brute_join(texts)
    assert ngramjoin.similar_documents(d.limit(0)).count() == 0
    odd = d.limit(3).unionByName(d.limit(3)).unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert ngramjoin.similar_documents(odd).count() == 7


def test_join_of_documents_in_several_rows(spark):
    text = lambda name, k: " ".join(f"{name}{i}" for i in range(k))
    rows = [(i, text(f"w{i}x", 100)) for i in range(6)]
    rows += [(i, text(f"v{i}x", 4)) for i in range(6)]
    rows += [(i + 10, text(f"w{i}x", 99)) for i in range(6)] + [(20, text("w0x", 50)), (21, text("w0x", 100)), (21, None), (21, text("w0x", 100).upper())]
    rows += [(30, text("a", 100)), (30, text("b", 100)), (31, text("a", 100))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.classes(d).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert out == {i: (k, n) for i, k, n in c.sql(ngramjoin.ORACLE_SQL).fetchall()}
    assert out[13] == (3, 1) and out[0] == (0, 2)


def test_join_of_one_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{i}"
        texts[i] = " ".join(w)
    out = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert out == brute_join(texts)


def test_join_with_hot_keys_and_split_places(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(ngramjoin, "PLACE", 5)
    texts = join_texts()
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    for i in range(40):
        w = list(base)
        for _ in range(i % 5 * 2):
            w[rng.randrange(len(w))] = f"x{i}"
        texts[1000 + i] = " ".join(w)
    d = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, similar long")
    out = ngramjoin.similar_documents(d)
    assert out.columns == [*d.columns, "_similar"]
    assert {r.doc_id: tuple(r._similar) for r in out.collect()} == brute_join(texts)


def test_join_finds_links_through_absorbed_newcomers(spark):
    """Chains x - y - z in which y is so close to x that it isn't kept as a leader, and z barely similar to y."""
    rng = random.Random(11)
    texts = {}
    for c in range(150):
        words = [f"c{c}w{i}" for i in range(200)]
        near = list(words)
        for i in rng.sample(range(0, 200, 12), 2):
            near[i] = f"c{c}n{i}"
        far = list(near)
        for i in rng.sample(range(3, 200, 11), 4):
            far[i] = f"c{c}f{i}"
        for w in (words, near, far):
            texts[len(texts)] = " ".join(w)
    out = {r.doc_id: r.class_id for r in ngramjoin.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(196)}
    linked = [i for i in range(0, len(texts), 3) if len(grams(texts[i + 1]) & grams(texts[i + 2])) >= 0.8 * len(grams(texts[i + 1]) | grams(texts[i + 2]))]
    assert len(linked) > 50 and sum(out[i + 1] == out[i + 2] for i in linked) >= 0.99 * len(linked)


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.9999), (0.5, 0.99), (0.95, 0.999)):
        bands, rows = ngramjoin.choose_bands(t, recall)
        assert 1 - (1 - t**rows) ** bands >= recall
    with pytest.raises(ValueError, match="minima"):
        ngramjoin.choose_bands(0.02, 0.9999)


def test_words_hash_as_they_split():
    texts = ["a b  c", "", None, "x" * 700 + " y", "é\tü\r\nz", " lead", "a b c"]
    got = ngramjoin.text_words(texts)
    for t, w in zip(texts, got, strict=True):
        assert len(w) == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert (w == ngramjoin.word_hashes((t or "").encode())).all()
    assert (got[0] == got[6]).all()


def test_components(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 3)] + [(200, 201 + i) for i in range(30)]
    out = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(31)}}
    monkeypatch.setattr(components, "HELD", 3)  # in rounds, instead of in one task
    assert {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == out
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_the_library(library):
    e = bpe.Encoder(open(bpe.default_vocabulary(), "rb").read())
    rng = random.Random(1)
    bits = ["a", "aa", "b", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "é", "ß", "\xa0", "!", "...", "<|endoftext|>", "漢", "🙂", "\u0558", "\u0663", "\x1c", "\x85", "the", "ing", "\u200b"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["a" * 5000 + " " * 300 + "\n" * 50 + "!?" * 2000, " lead", "trail ", "x\n y"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        packed = e.encode(t)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want, repr(t)
        assert e.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_bpe_caches_are_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    e = bpe.Encoder(open(bpe.default_vocabulary(), "rb").read())
    for t in ("one two three four five six seven eight", "eight nine one", "ten! eleven? one."):
        packed = e.encode(t)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode(t).ids
        assert len(e.pieces) <= 6


def test_bpe_keeps_the_table_of_a_start_for_words_that_share_it(library):
    held, rng = bpe.Encoder(open(bpe.default_vocabulary(), "rb").read()).vocabulary, random.Random(5)
    words = ["thessou" + "".join(rng.choices("aeinrstdlou", k=rng.randint(0, 9))) for _ in range(500)] + ["thess" * 2000, "thes", "thess"]
    for w in words + words:
        assert held.encode_letters(w) == library.encode(w, add_special_tokens=False).ids
    assert set(held._stems) == {"thess"}
    state, last = held._stems["thess"]
    assert len(last) == bpe.STEM + 1 and (state, last) == held.fill("thess", 0, [-1])


def test_bpe_of_a_vocabulary_of_over_65536(monkeypatch):
    import json

    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 300)
    letters = sorted(bpe.byte_alphabet().values())
    pairs = [(a, b) for a in letters for b in letters]
    random.Random(9).shuffle(pairs)
    ids = {x: i for i, x in enumerate(letters)}
    ids |= {a + b: len(letters) + i for i, (a, b) in enumerate(pairs)}
    extra = [(x, y) for x, y in zip(list(ids)[-400:-200], list(ids)[-200:], strict=True)]
    ids |= {a + b: len(ids) + i for i, (a, b) in enumerate(extra)}
    pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    spec = json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": pre, "truncation": None, "padding": None, "model": {"type": "BPE", "vocab": ids, "merges": [f"{a} {b}" for a, b in pairs + extra]}})
    library, mine, rng = Tokenizer.from_str(spec), bpe.Encoder(spec.encode()), random.Random(2)
    assert len(ids) > 65_536
    for _ in range(1500):
        text = "".join(rng.choices("abcdeXYZ019 éß.,", k=rng.randint(0, 30)))
        packed = mine.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode(text, add_special_tokens=False).ids, text
    assert len(mine.vocabulary._jumps) <= 300


def test_bpe_query(spark, library):
    d = spark.createDataFrame([(1, "some words here"), (2, None), (3, ""), (1, "some words here")], "doc_id long, text string").withColumn("token_ids", F.lit(1))
    out = bpe.digests(d).collect()
    ids = library.encode("some words here").ids
    assert [r.n_tokens for r in sorted(out, key=lambda r: r.doc_id)] == [len(ids), len(ids), 0, 0]
    assert {r.ids_sha256 for r in out if r.doc_id == 1} == {hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()}
    assert bpe.digests(d.limit(0)).count() == 0
