"""The registered queries against DuckDB, and the pipeline against brute force."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import langid, queries
from quarry.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_ops import brute_join, brute_lines


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    out = queries.queries()[name](spark, SMALL)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert rows_of(out.columns, map(tuple, out.collect())) == rows_of(want.columns, want.fetchall())


def test_pipeline_stages_in_turn(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    start = {r.doc_id: r.text for r in docs.collect()}

    def step(name, frame):
        path = str(tmp_path / name)
        dict(corpus_pipeline.STAGES)[name](spark, frame, SMALL).write.parquet(path)
        return spark.read.parquet(path)

    one = step("language", docs)
    p = langid.train(docs.filter(langid.learnable(F.col("doc_id"))))
    want = {i for i, t in start.items() if p.predict(t)[0] != "und" and p.predict(t)[1] >= corpus_pipeline.LEAST_COSINE}
    kept = {r.doc_id: r.text for r in one.collect()}
    assert set(kept) == want and one.columns == docs.columns

    two = step("lines", one)
    lines = {r.doc_id: r.text for r in two.collect()}
    assert lines == {i: x[2] for i, x in brute_lines(kept).items()} and two.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = step("near_copies", two)
    classes = brute_join(lines)
    assert {r.doc_id for r in three.collect()} == {i for i, (c, _) in classes.items() if c == i}

    four = step("mix", three)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}

    five = step("tokens", four)
    assert five.count() == four.count() and five.filter("NOT round_trip").count() == 0


def test_pipeline_keeps_columns_of_any_name_and_takes_empty_tables(spark):
    names = ["mix", "mix_shard", "mix_copy", "lines", "similar", "token_ids", "decoded", "language", "class_id", "_mix", "key", "size", "found"]
    docs = table(spark, SMALL, "documents").filter("doc_id < 40").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    odd = docs.limit(1)
    docs = docs.unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.withColumns({"doc_id": F.lit(900).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, SMALL)
            rows = out.collect()
            assert (len(rows) > 0) == (frame is docs)
            if name != "tokens":
                assert out.columns == frame.columns and all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in rows)


def test_language_stage_drops_unknown_scripts_and_keeps_clean_documents(spark):
    import random

    docs = table(spark, SMALL, "documents")
    rng = random.Random(4)
    made = lambda low, high: " ".join("".join(chr(rng.randint(low, high)) for _ in range(rng.randint(2, 9))) for _ in range(60))
    odd = [(10_000 + i, made(*r)) for i, r in enumerate([(0x430, 0x44F), (0x3B1, 0x3C9), (0x627, 0x64A), (0x4E00, 0x9000)] * 10)]
    more = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language"](spark, docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more), SMALL).collect()}
    assert not left & {i for i, _ in odd}
    clean = {r.doc_id for r in docs.collect() if sum(c.isalpha() for c in r.text or "") >= 40}
    assert len(clean - left) <= 0.01 * len(clean)
