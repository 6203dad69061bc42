from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import catalogue, schemas
from quarry.functions import geometry
from quarry.models import Models, hashed_bag, rerank_with
from quarry.operators import answers, bm25, centroids, common, dense, hybrid, images, inverted, mmr, spatial, store, validation
from quarry.plans.engine import Engine
from quarry.sources import binary
from quarry.streaming import ingest
from tests.conftest import SMALL


def test_bm25_equals_plain_calculation(spark):
    docs = {1: "the cat sat", 2: "the dog sat on the log", 3: "cats and dogs", 4: "the the the", 5: ""}
    frame = spark.createDataFrame(list(docs.items()), "id long, text string")
    asked = spark.createDataFrame([(1, "the cat cat ghost")], "query_id long, query string")
    got = {r.id: r.bm25_score for r in bm25.scores(bm25.build(frame), asked).collect()}
    words = {k: re.findall(r"\w+", v) for k, v in docs.items() if v}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for v in words.values() for w in set(v))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    for k, v in words.items():
        want = sum(idf.get(q, 0) * v.count(q) * 2.5 / (v.count(q) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for q in "the cat cat ghost".split())
        assert got.get(k, 0) == pytest.approx(want)


ASKED = [(1, "the nation of and"), (2, "und heit"), (3, "the the unseen"), (4, "of dataset que la"), (5, ""), (6, "nowhere")]


def found(index, asked, k):
    return sorted((r.query_id, r["rank"], r.id, round(r.bm25_score, 9)) for r in index.search(asked, k).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("SLOT_DOCS", 8), ("FREQUENT", 20), ("BUCKET_POSTINGS", 4000), ("FILE_POSTINGS", 90), ("SEEDS", 2)):
        monkeypatch.setattr(inverted, name, n)


def test_stored_index_gives_the_same_and_skips_blocks(spark, tmp_path, small_blocks):
    chunks = schemas.chunks(spark, SMALL)
    rare = chunks.filter("id = 7").select("id", F.concat("text", F.lit(" zanzibar zanzibar")).alias("text"))
    chunks = chunks.select("id", "text").filter("id <> 7").unionByName(rare)
    asked = spark.createDataFrame(ASKED, "query_id long, query string")
    index = inverted.Inverted(spark, str(tmp_path / "index"))
    state = index.update(chunks, whole=True)
    assert state["segments"][0]["buckets"] > 4
    built = bm25.build(chunks)
    for k in (1, 3, 10, 500):
        assert found(index, asked, k) == found(built, asked, k)
    terms = lambda t: sorted((r.term, r.df, round(r.idf, 9)) for r in t.collect())
    assert terms(index.terms()) == terms(built.terms)
    # heads are those of the frequent terms' blocks, no document's score passes the bound of its slot
    often = {r.term: r.df for r in index.terms().filter("df >= 20").collect()}
    assert {r.term: r.n for r in index.heads().groupBy("term").agg(F.sum("n").alias("n")).collect()} == often and often
    assert index.heads().agg(F.max("n")).first()[0] < 40
    weighed = index._weighed(asked)
    bounds = {(r.query_id, r.slot): r.bound for r in index.bounds(weighed).collect()}
    slots = -(-index.state()["segments"][0]["live"] // 8)
    dealt = index.scores(asked).withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)))
    assert all(r.bm25_score <= bounds[r.query_id, r.slot] + 1e-9 for r in dealt.collect())
    # a query with a rare word reads few blocks, and a plan doesn't read other buckets
    one = spark.createDataFrame([(1, "the zanzibar and of")], "query_id long, query string")
    weighed = index._weighed(one)
    every, read = (x.agg(F.sum("postings")).first()[0] for x in (index.bounds(weighed), index.needed(weighed, 1)))
    assert found(index, one, 1) == found(built, one, 1) and read < 0.25 * every
    plan = index.scores(one)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Python" not in plan
    index.release()


def test_search_of_texts_gives_the_same_and_stores_nothing(spark, monkeypatch):
    rows = [(1, "the cat the dog"), (2, "The bird"), (3, None), (4, "..."), (5, "dog dog dog cat"), (6, "the the the")]
    chunks = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(1, "the dog, the cat"), (2, "unheard bird"), (3, ""), (4, "dog")], "query_id long, query string")
    index = bm25.build(chunks)
    for most in (1_000, 0):
        monkeypatch.setattr(bm25, "MOST_NAMED", most)
        texts = bm25.Texts(chunks)
        for k in (2, 10):
            got, want = ({(r.query_id, r.rank, r.id): r.bm25_score for r in x.search(asked, k).collect()} for x in (texts, index))
            assert got == pytest.approx(want) and want
        assert bm25.Texts(chunks.limit(0)).search(asked, 2).count() == 0
        texts.release()
    index.release()


def test_hybrid_queries_store_no_index_and_move_no_texts(spark):
    catalogue.release()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("hybrid_topk", "hybrid_section_filter", "retrieve_text", "template_answer", "mmr_select"):
            plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert not catalogue._INDEXES, name
            assert re.search(r"BroadcastHashJoin \[id#\w+\], \[id#\w+\], LeftOuter", plan) and not re.search(r"SortMergeJoin \[id#\w+\], \[id#\w+\], LeftOuter", plan), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_follows_documents_by_segments(spark, tmp_path, small_blocks):
    rows = {r.id: r.text for r in schemas.chunks(spark, SMALL).collect()}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    asked = spark.createDataFrame([*ASKED, (7, "zebra the"), (8, "nation report zebra")], "query_id long, query string")
    index = inverted.Inverted(spark, str(tmp_path / "index"))
    index.update(frame(rows), source=1)
    first = index.state()["segments"][0]
    same = lambda: found(index, asked, 10) == found(bm25.build(frame(rows)), asked, 10)

    def change(new, gone=()):
        old = {i: rows[i] for i in [*gone, *[i for i in new if i in rows]]}
        index.update(frame(new) if new else None, frame(old) if old else None, source=index.state()["source"] + 1)
        for i in old:
            rows.pop(i)
        rows.update(new)

    change({900: "a zebra and the nation", 901: rows[3]})
    last = index.state()["segments"][-1]
    assert last["postings"] < 0.02 * first["postings"] and index.state()["segments"][0] == first and same()
    change({5: "zebra report of the nation", 6: "", 7: None}, gone=[8, 9])  # replaced, emptied, removed
    assert same()
    change({8: "back again, the zebra"})
    change({5: rows[5]})  # the same once more
    change({}, gone=[900])
    assert same() and len(index.state()["segments"]) == 6
    # the small segments are merged, the large one stays
    dead = sum(s["postings"] for s in index.state()["segments"])
    start = inverted.Inverted.run(index.state()["segments"])
    assert 0 < start < 3 and index.compact()
    assert [s["name"] for s in index.state()["segments"]][0] == first["name"] and len(index.state()["segments"]) == start + 1 and same()
    assert not index.compact()
    # an update that comes while a merge runs stays, and an update that a merge overtakes lands on top of it
    one, publish = inverted.Inverted(spark, str(tmp_path / "index")), index._publish
    index._publish = lambda state: (setattr(index, "_publish", publish), one.update(frame({950: "the late zebra"}), source=99), publish(state))
    assert index.compact(0)
    rows[950] = "the late zebra"
    assert len(index.state()["segments"]) == 2 and same() and sum(s["postings"] for s in index.state()["segments"]) < dead
    index._publish = lambda state: (setattr(index, "_publish", publish), one.compact(0), publish(state))
    index.update(frame({951: "later still, a zebra"}), source=100)
    rows[951] = "later still, a zebra"
    assert len(index.state()["segments"]) == 2 and index.state()["source"] == 100 and same()
    # of two updates from one state the second is refused
    index._publish = lambda state: (setattr(index, "_publish", publish), one.update(frame({952: "x"}), source=101), publish(state))
    with pytest.raises(store.Conflict):
        index.update(frame({953: "y"}), source=102)
    rows[952] = "x"
    index.vacuum(older_than=0)
    assert same() and {p.name for p in (tmp_path / "index" / "postings").iterdir()} == {f"segment={s['name']}" for s in index.state()["segments"]}
    assert len(index.versions.numbers()) == 1
    index.drop()
    assert not (tmp_path / "index").exists() and index.search(asked, 3).count() == 0


def nearest(index, asked, k):
    return sorted((r.query_id, r["rank"], r.id, round(r.dense_score, 9)) for r in index.search(asked, k).collect())


def exact(spark, rows, asked, k):
    vectors = spark.createDataFrame(list(rows.items()), "id long, embedding array<float>")
    return sorted((r.query_id, r["rank"], r.id, round(r.dense_score, 9)) for r in dense.search(vectors, asked, k).collect())


def test_merge_moves_postings_once(spark, tmp_path, monkeypatch):
    plans, write = [], inverted.Inverted._write_postings

    def seen(self, segment, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(self, segment, rows)

    monkeypatch.setattr(inverted.Inverted, "_write_postings", seen)
    rows = [spark.createDataFrame(r, "id long, text string") for r in ([(1, "cat dog"), (2, "bird")], [(1, "dog")], [(1, "cat dog")])]
    index = inverted.Inverted(spark, str(tmp_path / "i"))
    index.update(rows[0], whole=True)
    index.update(rows[1], rows[2])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert index.compact(0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[-1] and "SortMergeJoin" not in plans[-1]
    assert {(r.term, r.df) for r in index.terms().collect()} == {("dog", 1), ("bird", 1)}


def test_vector_index_is_exact_and_skips_partitions(spark, tmp_path, monkeypatch):
    import random

    for name, n in (("PARTITION_ROWS", 40), ("FILE_ROWS", 100)):
        monkeypatch.setattr(centroids, name, n)
    rng = random.Random(3)
    places = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    near = lambda at: [x + rng.gauss(0, 0.05) for x in at]
    rows = {i: near(places[i % 30]) for i in range(1200)}
    rows |= {2000 + i: places[0] for i in range(400)}  # a hot place: copies of one vector
    rows |= {3000: None, 3001: [0.0] * 12, 3002: [float("nan")] * 12, 3003: [1.0, 2.0], 3004: [], 3005: [None] * 12}
    asked = spark.createDataFrame([(1, near(places[4])), (2, near(places[0])), (3, [rng.gauss(0, 1) for _ in range(12)]), (4, [0.0] * 12), (5, [2.0, 1.0]), (6, None)], "query_id long, query_vec array<float>")
    table = lambda d: spark.createDataFrame(list(d.items()), "id long, embedding array<float>")
    clean = {i: None if i in (3002, 3005) else v for i, v in rows.items()}  # what isn't a number has no direction
    index = centroids.Centroids(spark, str(tmp_path / "v"))
    index.update(table(rows), whole=True, source=1)
    for k in (1, 7, 50):
        got = nearest(index, asked, k)
        assert got == exact(spark, clean, asked, k), k
    some = asked.filter("query_id < 3")
    assert index.share(some, 5) < 0.2
    plan = index._scored(index.needed(some, 5), "s")._jdf.queryExecution().executedPlan().toString()
    assert "centroid" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Python" not in plan
    # the hot partition lies in several files
    hot = [p for p in (tmp_path / "v" / "vectors").glob("segment=*/centroid=*") if len(list(p.glob("*.parquet"))) > 2]
    assert len(hot) >= 1
    # segments: new vectors, vectors that are replaced, vectors that go
    new = {5: near(places[9]), 5000: near(places[4]), 5001: [float(x) for x in range(12)]}
    gone = [5, 34, 64, 2000]
    index.update(table(new), spark.createDataFrame([(i,) for i in gone], "id long"), source=2)
    clean = {i: v for i, v in clean.items() if i not in gone} | new
    assert nearest(index, asked, 20) == exact(spark, clean, asked, 20) and len(index.state()["segments"]) == 2
    index.update(table({64: near(places[4])}), source=3)
    clean[64] = [r.embedding for r in index.vectors(index.state()).filter("id = 64 AND seq = 3").collect()][0]
    assert nearest(index, asked, 20) == exact(spark, clean, asked, 20)
    other = centroids.Centroids(spark, str(tmp_path / "v"))
    publish = other.versions.publish
    other.versions.publish = lambda *x: (index.update(table({1: near(places[2])}), source=4), publish(*x))
    with pytest.raises(store.Conflict):
        other.update(table({2: near(places[2])}), source=5)
    index.update(table(clean), whole=True, source=6)
    assert nearest(index, asked, 20) == exact(spark, clean, asked, 20) and len(index.state()["segments"]) == 1
    index.vacuum(older_than=0)
    assert nearest(index, asked, 3) == exact(spark, clean, asked, 3) and len(list((tmp_path / "v" / "facts").iterdir())) == 1
    empty = centroids.Centroids(spark, str(tmp_path / "e"))
    empty.update(table(rows).limit(0), whole=True)
    assert empty.search(asked, 3).count() == 0 and not empty.due()


def test_engine_index_follows_the_store(spark, tmp_path):
    text = "Paragraph {} about {} that is long enough to be a block of its own."
    page = lambda d, *words: [(d, 1, "\n\n".join(text.format(i, w) for i, w in enumerate(words)))]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, page int, text string")
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(frame([r for d in range(20) for r in page(d, "lions", "bread", f"word{d}")]))
    asked = spark.createDataFrame([(1, "word3 lions"), (2, "zebras"), (3, "bread block")], "query_id long, query string")
    same = lambda: found(e.index(), asked, 10) == found(bm25.build(bm25.searchable(e.store.read("chunks"))), asked, 10)
    assert same() and len(e.index().state()["segments"]) == 1
    e.ingest(frame([*page(3, "zebras", "bread"), *page(77, "word3")]))
    assert same() and [s["docs"] for s in e.index().state()["segments"]] == [60, 0] and e.index().state()["segments"][1]["gone"] == 2
    e.ingest(frame(page(78, "bread")))
    e.store.vacuum("chunks", older_than=0)  # takes the version that the index was made from
    assert same() and len(e.index().state()["segments"]) == 1
    assert Engine(spark, str(tmp_path / "s")).index().state() == e.index().state()


def test_plans_of_scoring_have_no_python(spark):
    for name in ("bm25_topk", "dense_topk", "hybrid_topk", "mmr_select"):
        plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_many_queries_meet_rows_in_blocks(spark, monkeypatch):
    vectors = schemas.vectors(spark, SMALL).select("id", "embedding")
    asked = vectors.filter("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    pictures = schemas.images(spark, SMALL)
    words = spark.createDataFrame([(i, f"nation {i} the report of region") for i in range(12)], "query_id long, query string")
    found = lambda df, c: sorted((r.query_id, r.id, round(r[c], 9)) for r in df.collect())
    runs = lambda: (found(dense.search(vectors, asked, 4), "dense_score"), found(images.text_scores(pictures, words), "score"))
    want = runs()
    for name, n in (("MOST_BROADCAST", 5), ("QUERIES_A_BLOCK", 4), ("ROWS_A_SLICE", 60)):
        monkeypatch.setattr(common, name, n)
    assert runs() == want and all(want)
    plan = dense.search(vectors, asked, 4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    monkeypatch.setattr(common, "MOST_BROADCAST", -1)
    assert dense.search(vectors.filter("id < 0"), asked, 4).count() == 0 and dense.search(vectors, asked.filter("query_id < 0"), 4).count() == 0


def test_mmr_keeps_the_first_and_prefers_difference(spark):
    rows = [(1, 1, 1, "hello world", 0.9), (1, 2, 2, "hello world", 0.8), (1, 3, 3, "other words here", 0.7), (1, 4, 4, "hello there", 0.6)]
    r = spark.createDataFrame(rows, "query_id long, id long, rank int, text string, hybrid_score double").withColumn("rerank_score", F.lit(None).cast("double"))
    assert [x.id for x in mmr.select(r, 2).orderBy("rank").collect()] == [1, 3]
    assert [x.id for x in mmr.select(r, 9).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_rerank_and_its_failure(spark):
    chunks, vectors = schemas.chunks(spark, SMALL), schemas.vectors(spark, SMALL)
    asked = schemas.queries(spark, SMALL, {1: ("the of and", 3)})
    good = hybrid.search_text(chunks, vectors, asked, 3, rerank=rerank_with(lambda q, t: [-len(x) for x in t])).collect()
    assert [r.rerank_score for r in sorted(good, key=lambda r: r["rank"])] == sorted((r.rerank_score for r in good), reverse=True)

    def broken(q, t):
        raise RuntimeError

    plain = [r.id for r in hybrid.search_text(chunks, vectors, asked, 3).orderBy("rank").collect()]
    assert [r.id for r in hybrid.search_text(chunks, vectors, asked, 3, rerank=rerank_with(broken)).orderBy("rank").collect()] == plain


def test_empty_collection(spark):
    chunks, vectors = schemas.chunks(spark, SMALL).limit(0), schemas.vectors(spark, SMALL).limit(0)
    asked = schemas.queries(spark, SMALL, {1: ("the of and", 3)})
    assert hybrid.search_text(chunks, vectors, asked, 3).count() == 0
    assert images.search(schemas.images(spark, SMALL).limit(0), asked, 3).count() == 0


def test_lsh_finds_a_subset(spark):
    asked = schemas.queries(spark, SMALL, {1: ("x", 3)})
    v = schemas.vectors(spark, SMALL)
    exact = {r.id: r.dense_score for r in dense.search(v, asked, 500).collect()}
    near = dense.lsh_search(v, asked, 5).collect()
    assert near and near[0].id == 3 and all(exact[r.id] == pytest.approx(r.dense_score) for r in near)


def test_overlap_and_distance(spark):
    b = geometry.box
    row = spark.range(1).select(
        geometry.overlap(b(0, 0, 2, 2), b(1, 1, 3, 3)).alias("part"),
        geometry.overlap(b(0, 0, 1, 1), b(1, 0, 2, 1)).alias("touch"),
        geometry.overlap(b(0, 0, 2, 2), b(0, 0, 2, 2)).alias("same"),
        geometry.distance(b(0, 0, 2, 2), b(3, 4, 5, 6)).alias("d"),
    ).first()
    assert row.part == pytest.approx(1 / 7) and row.touch == 0 and row.same == 1 and row.d == 5


def test_nearby_without_a_box_takes_the_first(spark):
    targets = spark.createDataFrame([(1, 1, 2, None)], f"target_id long, doc_id long, page int, bbox {schemas.BOX}")
    chunks = spark.createDataFrame([(i, 1, 2, "t", "s", (float(i), 0.0, 1.0, 1.0)) for i in range(5)], f"id long, doc_id long, page int, text string, section_heading string, bbox {schemas.BOX}")
    out = spatial.nearby(targets, chunks).orderBy("place").collect()
    assert [r.chunk_id for r in out] == [0, 1, 2] and out[0].distance is None


def test_upsert_is_idempotent_and_insert_keeps(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "id long, t string")
    once = store.upsert(a, b, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, store.upsert(once, b, ["id"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, store.insert_only(a, b, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_dimension_is_checked(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    assert store.with_dimension(v, 2).count() == 1
    with pytest.raises(Exception, match="components"):
        store.with_dimension(v, 3).collect()


def test_metadata_rules(spark):
    row = (0, None, [("a", None)], ["b"])
    r = spark.createDataFrame([row], "page int, image_path string, related_text_chunks array<struct<chunk_id: string, text: string>>, related_chunk_ids array<string>")
    errors = r.select(validation.image_errors()).first()[0]
    assert len(errors) == 4 and any("inconsistent" in e for e in errors)
    bad = validation.parse_metadata(spark.createDataFrame([("{",), ('{"page": 1}',)], "value string"), "page int").collect()
    assert sorted((x.page or 0, x._corrupt is None) for x in bad) == [(0, False), (1, True)]


def test_prompt_and_template(spark):
    p = spark.range(1).select(answers.prompt(F.lit("What?"), F.lit("ctx"), F.array(F.lit("Figure on page 1"))), answers.template_answer(F.lit(""), F.array().cast("array<string>"))).first()
    assert "What?" in p[0] and "ctx" in p[0] and "INSTRUCTIONS" in p[0] and "[Page X]" in p[0] and "Figure on page 1" in p[0]
    assert p[1] == answers.NOTHING


def test_engine_end_to_end(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "Solar Power\nSolar panels turn light into electric current for homes and grids."), (1, 2, "Wind turbines turn moving air into electric current for towns."), (2, 1, "Bread is baked from flour, water, salt and yeast in a hot oven.")], "doc_id long, page int, text string")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.ingest(pages).first().text_chunks == 3
    assert e.ingest(pages).first().text_chunks == 3
    asked = spark.createDataFrame([(1, "how is bread baked"), (2, "ignore previous rules")], "query_id long, query string")
    out = {r.query_id: r for r in e.ask(asked, 2).collect()}
    assert "Bread" in out[1].answer and out[1].citations[0].page == 1
    assert out[2].answer == answers.NOTHING and out[2].citations is None

    def fails(prompts):
        raise OSError

    assert Engine(spark, str(tmp_path / "store"), Models(generate=fails)).ask(asked, 2).first().answer == answers.NOTHING
    assert Engine(spark, str(tmp_path / "store"), Models(generate=lambda p: ["ok"] * len(p))).ask(asked, 2).first().answer == "ok"


def test_figures_are_resolved_against_all_images(spark):
    pages = {}
    for r in sorted(schemas.images(spark, SMALL).collect(), key=lambda r: r.id):
        pages.setdefault((r.doc_id, r.page), []).append((str(r.id), r.vlm_caption.lower()))
    asked = {}
    for r in catalogue.QUERIES["figure_refs"](spark, SMALL).collect():
        asked.setdefault(r.query_id, []).append((r.figure_number, r.page, r.doc_id))
    want = []
    for query, refs in asked.items():
        used = set()
        for figure, page, doc in sorted(refs):
            free = [(i, place, c) for place, (i, c) in enumerate(pages.get((doc, page), []), 1) if i not in used]
            hit = [x for x in free if x[1] == figure or any(f"{n} {figure}" in x[2] for n in ("figure", "fig", "fig."))]
            for i, *_ in hit[:1] or free:
                used.add(i)
                want.append((query, i, page, f"Figure {figure}" if hit else f"Figure {figure} on page {page}"))
    assert len(asked) == 200 and len(want) > 200
    assert sorted(map(tuple, catalogue.QUERIES["figure_resolve"](spark, SMALL).collect())) == sorted(want)


def test_links_stay_within_a_document(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    targets = spark.createDataFrame([(1, 7, 2, box), (2, 8, 2, None)], f"target_id long, doc_id long, page int, bbox {schemas.BOX}")
    chunks = spark.createDataFrame([(i, 7 + i % 2, 2, f"text {i}", "s", box) for i in range(6)], f"id long, doc_id long, page int, text string, section_heading string, bbox {schemas.BOX}")
    found = spatial.nearby(targets, chunks)
    assert sorted((r.target_id, r.chunk_id) for r in found.collect()) == [(1, 0), (1, 2), (1, 4), (2, 1), (2, 3), (2, 5)]
    pages = spark.createDataFrame([(8, 2, "a\nb\nc")], "doc_id long, page int, text string")
    blocks = chunks.select("doc_id", "page", F.col("id").alias("idx"), "text", "bbox")
    around = {r.target_id: r for r in spatial.surroundings(targets, blocks, pages).collect()}
    assert (around[2].before_text, around[2].after_text, around[2].surrounding_context) == ("a", "b\nc", "a\n\nb\nc")
    assert around[1].surrounding_context == ""


def test_similarity_of_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    monkeypatch.setattr(dense, "STRIP", 3)
    rows = [(r.id, r.embedding) for r in schemas.vectors(spark, SMALL).limit(40).collect()] + [(1000, None), (1001, [0.0] * 64)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")

    def cosine(x, y):
        if x is None or y is None or not any(x) or not any(y):
            return 0.0
        return sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))

    want = {(a, b): cosine(x, y) for a, x in rows for b, y in rows if a < b}
    got = {(r.a, r.b): r.similarity for r in dense.pairs(v).collect()}
    assert got == pytest.approx(want) and dense.pairs(v.limit(0)).count() == 0
    assert sum(r.n_pairs for r in dense.pair_summary(v).collect()) == len(want)


def test_similarity_moves_a_vector_a_few_times_and_counts_at_the_limits(spark, monkeypatch):
    for name, n in (("BLOCK", 1), ("STRIP", 5), ("COLUMNS", 7)):
        monkeypatch.setattr(dense, name, n)
    at = [0.5, 0.5 - 4e-7, 0.5 - 6e-7, 0.6, 0.6 - 6e-7, 0.7, 0.7 + 4e-7, 0.7 + 6e-7, 0.8, 0.8 - 4e-7, 0.8 - 6e-7, -0.9, 0.99]
    rows = [(i, [c, math.sqrt(1 - c * c)]) for i, c in enumerate(at)] + [(50 + i, [2.0, 0.0]) for i in range(30)] + [(50, [1.0, 0.0]), (90, None), (91, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)

    def similarity(x, y):
        return math.nan if any(z is not None and any(map(math.isnan, z)) for z in (x, y)) else round(sum(a * b for a, b in zip(x, y, strict=True)) / math.hypot(*x) / math.hypot(*y), 6) if x and y else 0.0

    s = [similarity(x, y) for a, x in rows for b, y in rows if a < b]
    low, medium, high = [z for z in s if not z >= 0.6], [z for z in s if 0.6 <= z < 0.8], [z for z in s if z >= 0.8]
    want = {n: (len(zs), sum(z > 0.7 for z in zs), sum(z < 0.5 for z in zs)) for n, zs in (("low", low), ("medium", medium), ("high", high))}
    assert {r[0]: tuple(r[1:]) for r in dense.pair_summary(v).collect()} == want
    assert dense.pairs(v).count() == len(s) and dense.pair_summary(v.limit(0)).count() == 0
    # 8 blocks, where there were as many as vectors and each was sent to all
    assert ", 36)" in dense.pairs(v)._jdf.queryExecution().executedPlan().toString()


def test_files_of_the_similarity_matrix_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 1 << 12)  # a block
    size = lambda path: sum(f.stat().st_size for f in path.glob("*.parquet"))
    for name, most, x in (("many", 0.85, F.randn), ("few", 1.05, lambda k: F.signum(F.randn(k)))):  # many and few different similarities
        rows = spark.range(0, 2000, 1, 2).select(F.col("id").alias("vec_id"), F.array(*[x(k).cast("float") for k in range(64)]).alias("embedding"))
        rows.write.parquet(str(tmp_path / name / "embeddings.parquet"))
        found = catalogue.queries()["similarity_matrix"](spark, str(tmp_path / name))
        found.write.parquet(str(tmp_path / name / "found"))
        written = spark.read.parquet(str(tmp_path / name / "found"))
        assert written.distinct().count() == written.count() == 2000 * 1999 // 2
        written.coalesce(1).sortWithinPartitions("a", "b").write.parquet(str(tmp_path / name / "by_ids"))
        assert size(tmp_path / name / "found") < most * size(tmp_path / name / "by_ids")


def test_rounded_similarities(spark, monkeypatch):
    odd = [1.0, 127.0, 15.0, 5.0, 2.0]  # of length 128
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 0.0]), (2, odd), (3, [-odd[0], *odd[1:]]), (3, [2.0, 0.0, 0.0, 0.0, 0.0]), (4, None), (5, [math.nan, 1.0, 0.0, 0.0, 0.0])]
    rows += [(20 - i, [math.cos(i * k) for k in range(1, 6)]) for i in range(9)] + [(30 + i, [0.0, 0.0, 0.0, 0.0, -2.0 - i]) for i in range(40)]

    def similarity(x, y):
        if x is None or y is None:
            return "nan" if any(map(math.isnan, x or y or [])) else 0.0
        s = sum(a * b for a, b in zip(x, y, strict=True)) / (math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y)))
        return "nan" if math.isnan(s) else math.copysign(math.floor(abs(s) * 1e6 + 0.5), s) / 1e6 + 0.0

    shown = lambda s: "nan" if math.isnan(s) else s
    want = sorted((a, b, str(similarity(x, y))) for a, x in rows for b, y in rows if a < b)
    assert (1, 2, "0.007813") in want and (1, 3, "-0.007813") in want  # 1 / 128 lies between two
    v = spark.createDataFrame([*rows, (None, odd)], "id long, embedding array<double>").repartition(3)
    assert sorted((r.a, r.b, str(shown(r.similarity))) for r in dense.pairs(v, 6).collect()) == want
    assert dense.pairs(v.limit(0), 6).count() == 0
    # areas, rows and batches of few pairs, in either order
    x = np.array([[0.0] * 5 if r[1] is None else r[1] for r in rows])
    parts = [dense._Block.of([(np.array([r[0] for r, k in zip(rows, keep, strict=True) if k]), x[keep])], 5) for keep in (np.array([r[0] < 16 for r in rows]), np.array([r[0] >= 16 for r in rows]))]
    for area, row, batch, dictionary in ((64, 5, 10, 3), (64, 7, 3, 1000), (8, 8, 8, 8), (1 << 24, 1 << 14, 5, 0)):
        for k, n in (("AREA", area), ("LONGEST_ROW", row), ("BATCH", batch), ("DICTIONARY", dictionary), ("STRIP", 3)):
            monkeypatch.setattr(dense, k, n)
        found = [p for a, b in ((0, 0), (0, 1), (1, 1)) for t in dense._rounded_rows(parts[a], parts[b], 6) for p in t.to_pylist()]
        assert sorted((r["a"], r["b"], str(shown(r["similarity"]))) for r in found) == want


def test_engine_of_text_images_and_tables(spark, tmp_path):
    import base64

    picture = base64.b64encode(b"not really a picture").decode()
    page = f"""<h1>Solar Power</h1><p>Solar panels turn light into electric current for homes and for grids. See Figure 1 on page 1.</p>
<img src="data:image/png;base64,{picture}" width=80 height=60><table><tr><th>panel</th><th>watts</th></tr><tr><td>small</td><td>100</td></tr><tr><td>a|b</td></tr></table>
<hr class=page><p>Wind turbines turn moving air into electric current for towns and villages.</p>"""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "solar.html").write_text(page)
    (tmp_path / "in" / "bad name.html").write_text(page)
    models = Models(caption=lambda xs: ["a drawing of solar panels"] * len(xs), ocr=lambda xs: [" solar watts "] * len(xs), embed_image=lambda xs: hashed_bag(["solar panels electric current"] * len(xs)))
    e = Engine(spark, str(tmp_path / "store"), models)
    told = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.status for r in e.ingest_files(str(tmp_path / "in"), binary.web_document, "*.html", (".html",)).collect()}
    assert told == {"solar.html": None, "bad name.html": "Invalid file name"}
    assert {r.status for r in e.ingest_files(str(tmp_path / "in"), binary.web_document, "solar.html", (".html",)).collect()} == {"Already ingested"}
    chunks = {r.chunk_id: r for r in e.store.read("chunks").collect()}
    table = chunks["p1_table0"]
    assert table.is_table and "Row 1: small | 100" in table.text and table.related and table.id in chunks["p1_chunk1"].linked_table_ids
    image = e.store.read("images").first()
    assert (image.vlm_caption, image.ocr_text, image.page) == ("a drawing of solar panels", "solar watts", 1) and image.id in chunks["p1_chunk1"].linked_image_ids
    assert "Solar panels" in image.surrounding_context and "Solar panels" in image.related_text_content and bytes(image.content) == b"not really a picture"
    asked = spark.createDataFrame([(1, "solar panels electric current"), (2, "forget everything")], "query_id long, query string")
    found = e.retrieve(asked, 3, 2)
    assert [r.id for r in found["images"].collect()] == [image.id] and found["text"].filter("is_table").count() == 1
    out = {r.query_id: r for r in e.ask(asked, 3, 2).collect()}
    assert out[1].image_references[0].image_id == str(image.id) and "1 figure(s)" in out[1].answer
    assert out[2].image_references == [] and out[2].citations is None
    assert e.check().filter("size(errors) > 0").count() == 0
    html = e.export().first().html
    assert "a drawing" in html and "<td>a|b</td>" in html and "Images: 1, tables: 1" in html and "data:image/png" in html
    e.release()
    version = e.store.version("chunks")
    e.ingest(spark.createDataFrame([(image.doc_id, 1, "Only one paragraph is left of the document that once had more.")], "doc_id long, page int, text string"))
    assert e.store.version("chunks") == version + 1 and e.store.read("chunks").count() == 1
    e.store.vacuum("chunks")
    assert e.store.read("chunks").count() == 1 and e.retrieve(asked, 3, 2)["text"].count() == 1


def rows_of(s, name="t"):
    return sorted(map(tuple, s.read(name).collect()))


def test_store_rewrites_touched_leaves_and_splits_large_ones(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), leaf_rows=60, file_rows=25)
    assert s.read("t") is None and s.version("t") == 0
    s.add("t", spark.range(500).select("id", F.lit("a").alias("x")), ["id"])
    first = s.snapshot("t")
    assert first.version == 1 and len(first.leaves) == 32 and sum(n for _, n in first.leaves.values()) == 500
    s.add("t", spark.createDataFrame([(3, "b")], "id long, x string"), ["id"])
    second = s.snapshot("t")
    assert len([x for x in second.leaves if second.leaves[x] != first.leaves[x]]) == 1
    assert rows_of(s) == sorted([(i, "b" if i == 3 else "a") for i in range(500)])
    for more in range(1, 5):  # grows without a leaf over the limit, and nothing is lost
        s.add("t", spark.range(500 * more, 500 * more + 500).select("id", F.lit("c").alias("x"), F.lit(more).alias("y")), ["id"])
    grown = s.snapshot("t")
    assert max(n for _, n in grown.leaves.values()) <= 60 and len(grown.leaves) > 64
    assert s.read("t").columns == ["id", "x", "y"] and s.read("t").count() == 2500 and s.read("t").filter("y IS NULL").count() == 500
    assert s.read("t", 2).count() == 500
    # a lookup reads the leaves of its keys only
    found = s.find("t", spark.createDataFrame([(3,), (777,), (9999,)], "id long"), "id")
    assert sorted((r.id, r.x) for r in found.collect()) == [(3, "b"), (777, "c")]
    assert len({f.split("/leaf=")[1].split("/")[0] for f in found.inputFiles()}) <= 3
    # rows of one key stay in one leaf, but in several files
    s.add("hot", spark.range(200).select(F.lit(1).alias("k"), "id"), ["k", "id"])
    full = [x for x in s.snapshot("hot").leaves.items() if x[1][1]]
    assert [n for _, (_, n) in full] == [200] and len(s.read("hot").inputFiles()) > 2
    before = rows_of(s)
    s.vacuum("t", older_than=0)
    assert rows_of(s) == before and s.versions("t").numbers() == [grown.version]
    folders = {v[0] for v in grown.leaves.values()}
    assert {p.name for p in (tmp_path / "s" / "t" / "data").iterdir()} == folders


@pytest.mark.parametrize(("other", "kept"), [([(901, "B")], False), ([(77, "B")], None)])
def test_two_writers_that_meet_both_land(spark, tmp_path, monkeypatch, other, kept):
    """B reads the version that A read, and publishes while A is about to."""
    frame = lambda rows: spark.createDataFrame(rows, "id long, x string")
    a, b = (store.Store(spark, str(tmp_path / "s"), leaf_rows=60) for _ in range(2))
    a.add("t", spark.range(500).select("id", F.lit("a").alias("x")), ["id"])
    publish, writes, met = a._publish, [], []
    write = a._write
    monkeypatch.setattr(a, "_write", lambda *x: writes.append(x[-1]) or write(*x))

    def late(name, held):
        if not met:
            met.append(1)
            b.add("t", frame(other), ["id"])
        publish(name, held)

    monkeypatch.setattr(a, "_publish", late)
    mine = [(901, "A")] if kept is False else [(3, "A")]
    a.add("t", frame(mine), ["id"])
    assert a.version("t") == 3
    want = {i: "a" for i in range(500)} | dict(other) | dict(mine)  # A came last
    assert rows_of(a) == sorted(want.items())
    same = kept is False or b._counts(b.snapshot("t", 1), frame(mine), "id")[0][0] == b._counts(b.snapshot("t", 1), frame(other), "id")[0][0]
    assert len(writes) == (2 if same else 1)  # elsewhere, what A had written stayed
    used = {v[0] for v in a.snapshot("t").leaves.values()}
    assert writes[-1] in used and (not same or not (tmp_path / "s" / "t" / "data" / writes[0]).exists())
    # both versions before can still be read
    assert a.read("t", 1).count() == 500 and a.read("t", 2).filter("x = 'B'").count() == 1
    with pytest.raises(store.Conflict):
        publish("t", store.Snapshot(3))


def test_store_takes_each_batch_of_a_stream_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, x string")
    assert s.add("t", frame((1, "a")).limit(0), ["id"], tag=("q", 0)).count() == 0 and s.version("t") == 1
    s.add("t", frame((1, "a")), ["id"], tag=("q", 1))
    s.add("t", frame((1, "b")), ["id"], tag=("q", 1))  # a replay
    s.add("t", frame((2, "c")), ["id"], tag=("other", 1))
    assert rows_of(s) == [(1, "a"), (2, "c")] and s.snapshot("t").tags == {"q": 1, "other": 1} and s.version("t") == 3


def test_a_bad_row_costs_no_other(spark):
    def picky(texts):
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    from quarry.models import batch_udf

    rows = spark.createDataFrame([("a",), ("bad",), ("b",)], "t string").coalesce(1)
    assert [r[0] for r in rows.select(batch_udf(picky, "string")("t")).collect()] == ["A", None, "B"]


def test_config_and_log(spark, tmp_path, monkeypatch):
    from quarry import config

    monkeypatch.setenv("QUARRY_TEXT_K", "7")
    assert config.Config.of(spark).text_k == 7
    spark.conf.set("spark.quarry.text_k", "4")
    assert config.Config.of(spark).text_k == 4
    spark.conf.unset("spark.quarry.text_k")
    log = config.logger("quarry-test", str(tmp_path / "log"))
    assert config.logger("quarry-test", str(tmp_path / "log")) is log and len(log.handlers) == 2
    assert all(config.check_setup(spark, str(tmp_path)).values())


def test_engine_keeps_chunks_of_long_pages_and_documents(spark, tmp_path):
    long = "\n\n".join(f"Paragraph {i} of a page that is far longer than pages usually are." for i in range(1030))
    one = "A single paragraph about {} that is long enough to be a block."
    rows = [(1, 1, long), (1, 2, one.format("zebras")), (1, 1025, one.format("giraffes")), (2, 1, one.format("lions")), (1 << 42, 1, one.format("hippos"))]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.ingest(pages).first().text_chunks == 1034
    assert e.ingest(pages).first().text_chunks == 1034
    chunks = e.store.read("chunks")
    assert chunks.select("id").distinct().count() == 1034
    assert [tuple(r) for r in chunks.orderBy("id").select("doc_id", "page").distinct().orderBy("doc_id", "page").collect()] == [r[:2] for r in rows]
    asked = spark.createDataFrame([(i, one.format(w)) for i, w in enumerate(("zebras", "giraffes", "lions", "hippos"))], "query_id long, query string")
    found = {(r.query_id, r.text) for r in e.retrieve(asked, 2)["text"].filter("rank = 1").collect()}
    assert found == {(i, one.format(w)) for i, w in enumerate(("zebras", "giraffes", "lions", "hippos"))}


def test_hashed_bag_is_unit():
    v = hashed_bag(["a b c", "", None])
    assert sum(x * x for x in v[0]) == pytest.approx(1) and v[1] is None and v[2] is None


def test_binary_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("one\ftwo".encode())
    (tmp_path / "b.pdf").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "c.txt").write_bytes(b"no")
    out = binary.decode(binary.files(spark, str(tmp_path)), binary.plain_text)
    assert sorted((r.page, r.text) for r in out.collect() if r._corrupt is None) == [(1, "one"), (2, "two")]
    assert binary.errors(out).count() == 1


def test_stream_upserts(spark, tmp_path):
    src, rows = tmp_path / "in", spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    rows.write.parquet(str(src))
    s = store.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        q = ingest.start(ingest.document_stream(spark, str(src), rows.schema), s, "docs", ["id"], str(tmp_path / "cp"), once=True)
        q.awaitTermination()
    spark.createDataFrame([(2, "B")], "id long, t string").write.mode("append").parquet(str(src))
    ingest.start(ingest.document_stream(spark, str(src), rows.schema), s, "docs", ["id"], str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(map(tuple, s.read("docs").collect())) == [(1, "a"), (2, "B")]
