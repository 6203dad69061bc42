"""Ingestion: large files, files that arrive, wrong vectors, cut blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.models import Models, hashed_bag
from quarry.plans.engine import Engine
from quarry.sources import binary
from quarry.streaming import ingest

WORDS = Models(embed_image=lambda xs: hashed_bag(["a picture"] * len(xs)))


def test_a_file_of_thousands_of_pages_and_images_takes_little_memory(spark, tmp_path):
    def long(content):
        import random
        import resource

        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        for page in range(1, 2001):
            yield "pages", page, f"page {page}"
            yield "images", page, "png", None, random.Random(page).randbytes(200_000) if page % 2 else bytes(200_000)
        yield "pages", 2001, str((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "large.pdf").write_bytes(b"x")
    rows = binary.guarded(binary.files(spark, str(tmp_path / "in")))
    binary.write(binary.decode_documents(rows, long), str(tmp_path / "out"))
    out = spark.read.schema(binary.ITEMS).parquet(str(tmp_path / "out"))
    pages, images = binary.part(out, "pages"), binary.part(out, "images")
    assert pages.count() == 2001 and images.agg(F.sum(F.octet_length("content"))).first()[0] == 400_000_000
    assert images.select("image_id").distinct().count() == 2000
    assert int(pages.filter("page = 2001").first().text) < 200  # MB, of the 400 that were read
    assert "PartitionFilters: [isnotnull(part" in pages._jdf.queryExecution().executedPlan().toString()
    # parts that aren't asked for don't leave the decoder
    assert {r.part for r in binary.decode_documents(rows, long, ("pages",)).select("part").distinct().collect()} == {"pages"}


def test_items_of_a_decoder_that_fails_are_left_out(spark, tmp_path):
    def half(content):
        yield "pages", 1, "the first page"
        if content == b"bad":
            raise ValueError("broken at page 2")
        yield "tables", 1, [["a", "b"], ["1", None]], (0, 0, 5, 5)
        yield "tables", 1, [], None
        yield "pages", 2, "the second page"

    for name in ("good", "bad"):
        (tmp_path / f"{name}.pdf").write_bytes(name.encode())
    out = binary.decode_documents(binary.guarded(binary.files(spark, str(tmp_path))), half).persist()
    assert [r.text for r in binary.part(out, "pages").orderBy("page").collect()] == ["the first page", "the second page"]
    table = binary.part(out, "tables").collect()
    assert len(table) == 1 and (table[0].table_id, table[0].headers, table[0].rows, table[0].bbox.x1) == ("p1_table0", ["a", "b"], [["1", None]], 5.0)
    assert [r.error for r in binary.errors(out).collect()] == ["broken at page 2"]


def test_web_pages_are_read_in_pieces(spark):
    page = "<h1>One</h1><p>first &amp; second</p><hr class=page><hr class=page><p>third</p><table><tr><th>a</th></tr><tr><td>1</td></tr></table><img src='data:image/png;base64,aGk='>"
    for step in (1, 7, 50, 1 << 16):
        got = sorted(binary.web_document(page.encode(), step), key=repr)
        assert got == sorted([("blocks", 1, "One", None), ("blocks", 1, "first & second", None), ("blocks", 3, "third", None), ("pages", 1, "One\n\nfirst & second"), ("pages", 2, ""), ("pages", 3, "third"), ("tables", 3, [["a"], ["1"]], None), ("images", 3, "png", None, b"hi")], key=repr), step
    assert list(binary.web_document(b"")) == [("pages", 1, "")]


def page_of(name, n=1):
    return "".join(f"<p>Paragraph {i} about {name} that is long enough to be a block of its own.</p><img src='data:image/png;base64,aGk='>" for i in range(n))


def test_files_that_arrive_are_ingested_once_even_after_a_crash(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.html").write_text(page_of("lions"))
    e = Engine(spark, str(tmp_path / "store"), WORDS)
    status = []

    def go(per_batch=1):
        stream = ingest.file_stream(spark, str(src), "*.html", per_batch)
        ingest.start_files(stream, e, str(tmp_path / "cp"), binary.web_document, (".html",), True, lambda df, _: status.extend((r.path[-9:], r.status) for r in df.collect())).awaitTermination()

    go()
    (src / "two.html").write_text(page_of("bread", 2))
    (src / "bad name.html").write_text(page_of("nothing"))
    (src / "x.txt").write_text("no")
    add, failed = e.store.add, []

    def fails(name, *a, **k):  # after the texts of a batch, before its images
        if name == "images" and not failed:
            failed.append(1)
            raise OSError("killed")
        return add(name, *a, **k)

    monkeypatch.setattr(e.store, "add", fails)
    with pytest.raises(Exception, match="killed"):
        go(9)
    assert failed and e.store.read("chunks").count() == 3 and e.store.read("images").count() == 1
    before = e.store.version("chunks")
    go(9)
    assert e.store.read("chunks").count() == 3 and e.store.read("images").count() == 3
    assert e.store.version("chunks") == before  # the replay left the texts as they were
    go()
    assert e.store.version("chunks") == before and e.store.read("images").count() == 3
    assert ("bad name.html"[-9:], "Invalid file name") in [(a.replace("%20", " "), b) for a, b in status] or any(b == "Invalid file name" for _, b in status)
    (src / "one.html").unlink()
    (src / "three.html").write_text(page_of("zebras"))
    go()
    assert e.store.read("chunks").count() == 4
    asked = spark.createDataFrame([(1, "zebras"), (2, "lions")], "query_id long, query string")
    assert {(r.query_id, "zebras" in r.text) for r in e.retrieve(asked, 1)["text"].collect()} == {(1, True), (2, False)}
    e.vacuum(older_than=0)
    assert e.store.read("images").count() == 4 and list((tmp_path / "store" / "decoded").iterdir()) == []
    assert e.retrieve(asked, 1)["text"].count() == 2


def test_images_without_a_vector_are_left_out_and_dimensions_are_checked(spark, tmp_path):
    text = "Paragraph one about lions that is long enough to be a block of its own."
    pages = lambda d: spark.createDataFrame([(d, 1, text)], "doc_id long, page int, text string")
    picture = lambda d: spark.createDataFrame([(d, 1, f"p1_img{i}", "png", None, bytes([i])) for i in range(3)], binary_images())
    some = Models(embed_image=lambda xs: [None if x == b"\x01" else [1.0, 0.0] for x in map(bytes, xs)])
    e = Engine(spark, str(tmp_path / "s"), some)
    assert e.ingest(pages(1), picture(1)).first().images == 2
    assert sorted(r.image_id for r in e.images().collect()) == ["p1_img0", "p1_img2"]
    wide = Engine(spark, str(tmp_path / "s"), Models(embed_image=lambda xs: [[1.0, 0.0, 0.0]] * len(xs)))
    with pytest.raises(Exception, match="should have 2 components"):
        wide.ingest(pages(2), picture(2))
    short = Engine(spark, str(tmp_path / "s"), Models(embed=lambda xs: [[1.0]] * len(xs)))
    with pytest.raises(Exception, match="should have 64 components"):
        short.ingest(pages(3))
    set_ = Engine(spark, str(tmp_path / "t"), some, Config(image_dimension=5))
    with pytest.raises(Exception, match="should have 5 components"):
        set_.ingest(pages(1), picture(1))
    assert e.store.read("images").count() == 2


def binary_images():
    from quarry.schemas import DECODED_IMAGES

    return DECODED_IMAGES


def test_blocks_are_cut_to_the_size_that_is_set(spark, tmp_path):
    long = " ".join(f"Sentence number {i} of a paragraph that goes on and on." for i in range(18))
    rows = [(1, 1, f"{long}\n\nA short paragraph that is still long enough to be a block by itself."), (1, 2, long)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    whole, cut = Engine(spark, str(tmp_path / "a"), config=Config()), Engine(spark, str(tmp_path / "b"), config=Config(chunk_size=300, chunk_overlap=0))
    whole.ingest(pages), cut.ingest(pages)
    a, b = (sorted(e.store.read("chunks").select("page", "chunk_id", "text", "id").collect(), key=lambda r: (r.page, int(r.chunk_id.split("chunk")[1]))) for e in (whole, cut))
    assert len(b) > len(a) and max(len(r.text) for r in b) <= 600 and len({r.id for r in b}) == len(b)
    assert [r.chunk_id for r in b if r.page == 1] == [f"p1_chunk{i}" for i in range(sum(r.page == 1 for r in b))]
    assert "".join("".join(r.text for r in b).split()) == "".join("".join(r.text for r in a).split())


def test_a_model_is_built_once_a_worker_and_bad_rows_cost_few_calls(spark, tmp_path):
    from quarry.models import Built, batch_udf

    log = str(tmp_path / "log")

    def make():
        import os

        with open(log, "a") as f:
            f.write(f"built {os.getpid()}\n")

        def model(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            if "bad" in texts:
                raise ValueError
            return [t.upper() for t in texts]

        return model

    rows = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 501, "bad").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("t"))
    upper = batch_udf(Built(make, 50), "string")
    for _ in range(2):
        out = {r[0]: r[1] for r in rows.select("t", upper("t")).collect()}
        assert out.pop("bad") is None and all(b == a.upper() for a, b in out.items()) and len(out) == 999
    lines = open(log).read().split("\n")[:-1]
    built = [x for x in lines if x.startswith("built")]
    assert len(built) == len(set(built)) <= 8  # no worker built it twice, whatever its tasks
    sizes = [int(x) for x in lines if not x.startswith("built")]
    assert max(sizes) == 50 and len(sizes) <= 2 * (8 * 3 + 2 * 7)


def test_metadata_of_any_fields(spark, tmp_path):
    from quarry.operators import metadata, store

    rows = [("a", '{"page": 3, "text": "x", "metadata_version": "1.1", "last_updated": "2024-05-06T07:08:09", "weight": {"kg": 2.5}, "tags": ["p", "q"]}'), ("b", '{"page": "three", "image_path": "i.png"}'), ("c", '{"page": 1'), ("d", None), ("e", "[1, 2]"), ("f", "{}")]
    out = {r.id: r for r in metadata.read(spark.createDataFrame(rows, "id string, value string")).drop("fields").collect()}
    assert {k: (r.state, r.kind) for k, r in out.items()} == {"a": ("current", "text"), "b": ("old", "image"), "c": ("corrupt", None), "d": ("missing", None), "e": ("corrupt", None), "f": ("old", "unknown")}
    assert out["a"].others == ["tags", "weight"] and out["a"].page == 3 and out["a"].last_updated.year == 2024 and out["a"].related_chunk_ids is None
    assert out["b"].page is None and out["b"].related_chunk_ids == [] and out["b"].related_text_chunks == [] and out["b"].metadata_version == "1.1"
    for name, text in rows:
        if text is not None:
            (tmp_path / f"{name}.x.json").write_text(text + "\n")
    e = Engine(spark, str(tmp_path / "s"))
    told = {r.state: r.n for r in e.ingest_metadata(metadata.sidecars(spark, str(tmp_path))).collect()}
    assert told == {"current": 1, "old": 2, "corrupt": 2}
    held = e.metadata(spark.createDataFrame([("a.x",), ("c.x",)], "id string"))
    got = held.select("id", metadata.field("weight.kg", "double"), metadata.field("tags[1]"), F.col("last_updated").isNotNull()).collect()
    assert [tuple(r) for r in got] == [("a.x", 2.5, "q", True)] and e.metadata().count() == 3
    again = store.as_json(spark.createDataFrame([(1, "x")], "id long, text string"), updated=F.lit("2025-01-01 00:00:00").cast("timestamp"))
    back = metadata.read(again.select("id", F.col("metadata").alias("value"))).first()
    assert (back.state, back.text, back.last_updated.year, back.others) == ("current", "x", 2025, ["id"])
