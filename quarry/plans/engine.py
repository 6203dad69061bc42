"""The engine: ingest documents, retrieve for queries, answer with citations and figures."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config, logger
from quarry.functions import geometry, render
from quarry.functions.text import sanitize_query
from quarry.models import Models, batch_udf, process_images, rerank_with
from quarry.operators import answers, bm25, centroids, chunking, hybrid, images, inverted, metadata, mmr, reports, spatial, validation
from quarry.operators.store import Conflict, Store, image_defaults, with_dimension
from quarry.schemas import BOX, DECODED_IMAGES, DECODED_TABLES
from quarry.sources import binary

TABLE_SECTION = "Tables"
_LINKS = "array<string>"


def retrieve(chunks: DataFrame, vectors: DataFrame | centroids.Centroids, pictures: DataFrame | None, queries: DataFrame, text_k: int = 5, image_k: int = 3, rerank=None, index: bm25.Index | inverted.Inverted | None = None, links: DataFrame | None = None, least_vector: float = 0.5, least_text: float = 0.5) -> dict[str, DataFrame | None]:
    """text: diversified hybrid results; images: results of the image ways."""
    found = hybrid.search_text(chunks, vectors, queries, 2 * text_k, index=index, rerank=rerank)
    text = mmr.select(found, text_k)
    seen = images.search(pictures, queries, image_k, least_vector, least_text, text_results=text, links=links) if pictures is not None else None
    return {"text": text, "images": seen}


#: Kinds of local ids, in the order in which they are told apart: p1_chunk0, p1_img0, p1_table0.
KINDS = ("_chunk", "_img", "_table")


def with_id(rows: DataFrame, name: str = "chunk_id") -> DataFrame:
    """rows with id: doc_id * 2^63 + page * 2^31 + four times the number in the local id + its kind, which
    no two rows share; in their order."""
    wide = lambda c: c.cast("long").cast("decimal(20,0)")
    kind = F.lit(0)
    for i, k in enumerate(KINDS[1:], 1):
        kind = F.when(F.contains(F.col(name), F.lit(k)), i).otherwise(kind)
    number = wide(F.regexp_extract(name, r"(\d+)$", 1)) * F.lit(4).cast("decimal(2,0)") + wide(kind)
    page = wide(F.col("page")) * F.lit(1 << 31).cast("decimal(10,0)")
    document = wide(F.col("doc_id")) * F.lit(str(1 << 63)).cast("decimal(19,0)")
    return rows.withColumn("id", (document + page + number).cast("decimal(38,0)"))


def link(targets: DataFrame, chunks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """targets (target_id, doc_id, page, bbox) with what is near them (related, related_chunk_ids,
    related_text_content), and chunks (doc_id, chunk_id, ...) with the targets near them as `name`."""
    found = spatial.nearby(targets, chunks)
    near = spatial.related(found)
    near = near.select("target_id", "related", "related_chunk_ids", render.related_content(F.col("related")).alias("related_text_content"))
    out = targets.join(near, "target_id", "left")
    empty = {"related": F.array().cast(near.schema["related"].dataType), "related_chunk_ids": F.array().cast(near.schema["related_chunk_ids"].dataType), "related_text_content": F.lit("")}
    return out.withColumns({c: F.coalesce(c, x) for c, x in empty.items()}), spatial.reverse_links(chunks, found, name)


@dataclass
class Engine:
    """Tables below a path, models by hooks. All methods take and return DataFrames."""

    spark: SparkSession
    path: str
    models: Models = field(default_factory=Models)
    config: Config | None = None

    def __post_init__(self):
        self.store = Store(self.spark, self.path)
        self.config = self.config or Config.of(self.spark)
        self.log = logger(file=self.config.log_file)
        self._indexes: dict[str, inverted.Inverted | centroids.Centroids] = {}

    # ---- ingestion

    def ingest_files(self, path: str, decoder: Callable = binary.plain_document, pattern: str = "*.pdf", extensions: tuple[str, ...] | None = None, again: bool = False) -> DataFrame:
        """Files below path through the guards of names and sizes, decoded and ingested; those whose name
        the store holds are left out unless `again`. A row per file: path, doc_id, and why it was refused,
        left out or couldn't be read (status, null if it was taken)."""
        return self.ingest_binary(binary.files(self.spark, path, pattern), decoder, extensions, again)

    def ingest_binary(self, files: DataFrame, decoder: Callable = binary.plain_document, extensions: tuple[str, ...] | None = None, again: bool = False, tag: tuple[str, int] | None = None) -> DataFrame:
        """ingest_files() of files (path, length, content). tag: the name of a stream and the number of a
        batch, which each table of the store takes once however often it is replayed."""
        rows = binary.guarded(files, extensions)
        held = None if again else self.store.find("chunks", rows, "doc_id")
        rows = rows.withColumn("status", F.col("refused"))
        if held is not None:
            known = held.select("doc_id", F.lit(True).alias("known")).distinct()
            rows = rows.join(known, "doc_id", "left").withColumn("status", F.coalesce("status", F.when(F.col("known"), "Already ingested"))).drop("known")
        taken = rows.filter("status IS NULL")
        folder = f"{self.path}/decoded/{uuid.uuid4().hex}"  # files are decoded once, whatever is made of them
        binary.write(binary.decode_documents(taken, decoder), folder)
        decoded = self.spark.read.schema(binary.ITEMS).parquet(folder)
        if tag is not None or not decoded.filter(F.col("part") != binary.ERRORS).isEmpty():
            self.ingest(*(binary.part(decoded, x) for x in ("pages", "images", "tables", "blocks")), tag=tag)
        told = rows.select("path", "doc_id", "status").join(binary.errors(decoded), "path", "left")
        return told.select("path", "doc_id", F.coalesce("status", "error").alias("status"))

    def _dimensioned(self, rows: DataFrame, name: str, wanted: int) -> DataFrame:
        """rows, whose vectors must have the dimension that is set, or else that of the stored ones."""
        held = None if wanted else self.store.read(name)
        if held is not None:
            first = held.filter("embedding IS NOT NULL").select(F.size("embedding")).first()
            wanted = first[0] if first else 0
        return with_dimension(rows, wanted) if wanted else rows

    def ingest(self, pages: DataFrame, images: DataFrame | None = None, tables: DataFrame | None = None, blocks: DataFrame | None = None, tag: tuple[str, int] | None = None) -> DataFrame:
        """Text, images and tables of documents into the store; a summary row.

        pages: doc_id, page, text; images and tables as in schemas.DECODED_IMAGES and DECODED_TABLES; blocks
        (doc_id, page, idx, text, bbox): where text stands, for captions and surroundings. A document that
        comes again replaces all of its former rows. Blocks are cut to the size that is set, if one is. Images
        without a vector are left out, and vectors of a wrong dimension are an error. tag: see ingest_binary().
        """
        spark = self.spark
        images = spark.createDataFrame([], DECODED_IMAGES) if images is None else images
        tables = spark.createDataFrame([], DECODED_TABLES) if tables is None else tables
        blocks = spark.createDataFrame([], f"doc_id long, page int, idx int, text string, bbox {BOX}") if blocks is None else blocks
        headed = chunking.page_headings(pages, ["doc_id"], ["page"]).select("doc_id", "page", "section_heading")
        text = chunking.text_blocks(pages).join(headed, ["doc_id", "page"])
        if self.config.chunk_size:
            text = chunking.cut_blocks(text, self.config.chunk_size, self.config.chunk_overlap)
        text = with_id(text).withColumn("bbox", F.lit(None).cast(BOX)).select("id", "doc_id", "page", "chunk_id", "section_heading", "text", "bbox")
        images, tables = with_id(images, "image_id"), with_id(tables, "table_id")

        near_images, text = link(images.select(F.col("id").alias("target_id"), "doc_id", "page", "bbox"), text, "linked_image_ids")
        boxed = F.coalesce("bbox", geometry.box(*geometry.TABLE_BOX))
        near_tables, text = link(tables.select(F.col("id").alias("target_id"), "doc_id", "page", boxed.alias("bbox")), text, "linked_table_ids")

        kind = near_tables.schema["related"].dataType
        ids = text.schema["linked_image_ids"].dataType
        head, cells = F.coalesce("headers", F.array().cast(_LINKS)), F.coalesce("rows", F.array().cast("array<array<string>>"))
        meta = F.struct(head.alias("headers"), cells.alias("rows"), F.size(cells).alias("num_rows"), F.size(head).alias("num_cols"), render.markdown(head, cells).alias("markdown"), render.html_table(head, cells).alias("html"), render.csv(head, cells).alias("csv"))
        as_chunks = tables.join(near_tables.drop("doc_id", "page", "bbox").withColumnRenamed("target_id", "id"), "id")
        as_chunks = as_chunks.select(
            "id", "doc_id", "page", F.col("table_id").alias("chunk_id"), F.lit(TABLE_SECTION).alias("section_heading"), render.table_text(F.col("page"), head, cells).alias("text"),
            F.lit(True).alias("is_table"), F.array().cast(ids).alias("linked_image_ids"), F.array().cast(ids).alias("linked_table_ids"), "related", "related_text_content", meta.alias("table_meta"),
        )
        text = text.select(
            "id", "doc_id", "page", "chunk_id", "section_heading", "text", F.lit(False).alias("is_table"), "linked_image_ids", "linked_table_ids",
            F.array().cast(kind).alias("related"), F.lit("").alias("related_text_content"), F.lit(None).cast(as_chunks.schema["table_meta"].dataType).alias("table_meta"),
        )
        rows = text.unionByName(as_chunks).withColumn("embedding", batch_udf(self.models.embed, "array<float>")("text"))
        rows = self._dimensioned(rows, "chunks", self.config.text_dimension)
        chunks = self.store.add("chunks", rows, ["doc_id", "id"], whole=["doc_id"], tag=tag)

        targets = images.select(F.col("id").alias("target_id"), "doc_id", "page", "bbox")
        around = spatial.surroundings(targets, blocks, pages).select(F.col("target_id").alias("id"), "surrounding_context")
        captions = spatial.captions(targets, blocks).select(F.col("target_id").alias("id"), F.col("caption").alias("original_caption"))
        pictures = images.join(near_images.drop("doc_id", "page", "bbox").withColumnRenamed("target_id", "id"), "id").join(captions, "id").join(around, "id")
        path = F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("image_id"), F.lit("."), F.col("format"))
        pictures = process_images(pictures, self.models).withColumn("image_path", path)
        pictures = self._dimensioned(pictures.filter("embedding IS NOT NULL"), "images", self.config.image_dimension)
        held = self.store.add("images", pictures, ["doc_id", "id"], whole=["doc_id"], tag=tag)
        out = reports.ingest_summary(chunks, held.select("id"))
        self.log.info("ingested into %s, version %d", self.path, self.store.version("chunks"))
        return out

    def ingest_metadata(self, lines: DataFrame) -> DataFrame:
        """JSON metadata (id, value) into the table `metadata`, known fields as columns; missing and corrupt ones
        are left out. The number of each state."""
        rows = metadata.read(lines)
        good = rows.filter("state IN ('old', 'current')").withColumn("last_updated", F.coalesce("last_updated", F.current_timestamp()))
        self.store.add("metadata", good, ["id"])
        return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"))

    def metadata(self, ids: DataFrame | None = None) -> DataFrame | None:
        """The metadata of ids (id), of which only their leaves are read, or all."""
        return self.store.read("metadata") if ids is None else self.store.find("metadata", ids, "id")

    # ---- retrieval

    def _follow(self, index: inverted.Inverted | centroids.Centroids, rows: Callable[[DataFrame], DataFrame], same: list[str]):
        """Bring an index up to the present chunks. Where chunks have changed since it was made, it gets a
        segment with the rows that came and went, found in the leaves of the table that differ; without the
        version it was made from, which vacuum() may have removed, it starts anew."""
        while (now := self.store.snapshot("chunks")).version != (source := index.state()["source"]):
            try:
                if source not in self.store.versions("chunks").numbers():
                    index.update(rows(self.store.read("chunks", now.version)), source=now.version, whole=True)
                else:
                    before = self.store.snapshot("chunks", source)
                    came, gone = (rows(self.store.changed("chunks", a, b)) for a, b in ((now, before), (before, now)))
                    index.update(came.join(gone, same, "left_anti"), gone.join(came, same, "left_anti"), source=now.version)
            except Conflict:  # another session has made the index meanwhile
                continue
        return index

    def _held(self, kind: str, index):
        """The index that is loaded, if it is the newest, else the given one in its place."""
        old = self._indexes.get(kind)
        if old is None or old.state()["version"] != index.state()["version"]:
            if old is not None:
                old.release()
            self._indexes[kind] = index.pin()
        return self._indexes[kind]

    def index(self) -> inverted.Inverted:
        """The BM25 index of the present chunks."""
        index = self._follow(inverted.Inverted(self.spark, f"{self.path}/index"), bm25.searchable, ["id", "text"])
        index.compact()
        return self._held("terms", index)

    def vectors(self) -> centroids.Centroids:
        """The index of the present chunks' vectors."""
        rows = lambda c: c.select("id", "embedding")
        index = self._follow(centroids.Centroids(self.spark, f"{self.path}/vectors"), rows, ["id", "embedding"])
        if index.due():
            index.update(rows(self.store.read("chunks", index.state()["source"])), source=index.state()["source"], whole=True)
        return self._held("vectors", index)

    def release(self) -> None:
        """Forget the indexes, and what they keep in memory."""
        for index in self._indexes.values():
            index.release()
        self._indexes.clear()

    def images(self) -> DataFrame | None:
        """The stored images, empty texts for missing ones."""
        held = self.store.read("images")
        return None if held is None else image_defaults(held)

    def _asked(self, queries: DataFrame) -> DataFrame:
        asked = queries.withColumn("query", self.models.expand(sanitize_query(F.col("query")))).filter("query <> ''")
        return asked.withColumn("query_vec", batch_udf(self.models.embed, "array<float>")("query"))

    def retrieve(self, queries: DataFrame, text_k: int | None = None, image_k: int | None = None) -> dict[str, DataFrame | None]:
        """text and images for queries (query_id, query); refused queries find nothing."""
        c = self.config
        text_k, image_k = text_k or c.text_k, image_k or c.image_k
        chunks, asked = self.store.read("chunks"), self._asked(queries)
        rerank = rerank_with(self.models.rerank) if self.models.rerank else None
        links = chunks.select("id", F.explode("linked_image_ids").alias("image_id"))
        found = retrieve(chunks, self.vectors(), self.images(), asked, text_k, image_k, rerank, self.index(), links, c.least_vector, c.least_text)
        facts = chunks.select("id", "doc_id", "chunk_id", "related", "related_text_content", "table_meta")
        found["text"] = found["text"].join(facts, "id", "left")
        if found["images"] is not None:
            found["images"] = found["images"].join(self.images().drop("content", "embedding"), "id")
        return found

    def ask(self, queries: DataFrame, text_k: int | None = None, image_k: int | None = None) -> DataFrame:
        """(query_id, answer, citations, image_references) for queries (query_id, query, and where there is one the
        history of the conversation, see operators.history): the images found, and those that the figures named in the answer stand for."""
        found = self.retrieve(queries, text_k, image_k)
        text = found["text"].withColumn("table_html", F.coalesce("table_meta.html", F.lit("")))
        rows = queries.join(answers.contexts(text), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        none = F.array().cast("array<string>")
        if found["images"] is not None:
            rows = rows.join(answers.figure_contexts(found["images"]), "query_id", "left").withColumn("figures", F.coalesce("figures", none))
        else:
            rows = rows.withColumn("figures", none)
        answer = answers.template_answer(F.col("context"), F.col("figures"))
        if self.models.generate is not None:
            before = F.col("history") if "history" in rows.columns else None
            said = batch_udf(self.models.generate, "string")(answers.prompt(F.col("query"), F.col("context"), F.col("figures"), before))
            answer = F.coalesce(said, answers.template_answer(F.lit(""), none))
        rows = rows.select("query_id", answer.alias("answer"), "citations")
        one = "array<struct<image_id: string, page: int, caption: string>>"
        if found["images"] is None:
            return rows.withColumn("image_references", F.array().cast(one))
        shown = answers.image_references(found["images"].orderBy("rank"))
        where = text.select("query_id", "doc_id", "page").distinct()
        refs = answers.figure_references(rows, where).join(where.select("query_id", "doc_id").distinct(), "query_id")
        more = answers.resolve_figures(refs, self.images(), shown)
        listed = shown.withColumn("kind", F.lit(0)).unionByName(more.withColumn("kind", F.lit(1)))
        listed = listed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("kind", "page", "image_id", "caption"))).alias("l"))
        listed = listed.select("query_id", F.transform("l", lambda x: F.struct(x["image_id"].alias("image_id"), x["page"].alias("page"), x["caption"].alias("caption"))).cast(one).alias("image_references"))
        out = rows.join(listed, "query_id", "left")
        return out.withColumn("image_references", F.coalesce("image_references", F.array().cast(one)))

    # ---- upkeep

    def vacuum(self, older_than: float = 24 * 3600) -> None:
        """Remove what no present version needs and is older than so many seconds: rows, segments of the
        indexes, and items that were decoded."""
        self.index(), self.vectors()
        for name in ("chunks", "images"):
            self.store.vacuum(name, older_than=older_than)
        for kind in (inverted.Inverted(self.spark, f"{self.path}/index"), centroids.Centroids(self.spark, f"{self.path}/vectors")):
            kind.vacuum(older_than)
        self.store.versions("").sweep(f"{self.path}/decoded", older_than)

    def check(self) -> DataFrame:
        """(collection, id, kind, errors) of all stored metadata."""
        chunks = self.store.read("chunks")
        kind = F.when(F.col("is_table"), "table").otherwise("text")
        some = "array<struct<chunk_id: string, text: string>>"
        rules = lambda rows, kind: rows.select(
            "id", kind.alias("kind"), "page",
            *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("is_table", "boolean"), ("image_path", "string"))],
            *[(F.col(f"table_meta.{c}") if "table_meta" in rows.columns else F.lit(None).cast("int")).alias(c) for c in ("num_rows", "num_cols")],
            F.transform("related", lambda c: F.struct(c["chunk_id"].cast("string").alias("chunk_id"), c["text"].alias("text"))).cast(some).alias("related_text_chunks"),
            (F.col("related_chunk_ids").cast(_LINKS) if "related_chunk_ids" in rows.columns else F.lit(None).cast(_LINKS)).alias("related_chunk_ids"),
        )
        out = validation.consistency(chunks, rules(chunks, kind)).withColumn("collection", F.lit("text"))
        held = self.store.read("images")
        if held is not None:
            out = out.unionByName(validation.consistency(held, rules(held, F.lit("image"))).withColumn("collection", F.lit("images")))
        return out

    def export(self, title: str = "Content") -> DataFrame:
        """(doc_id, html): the stored images and tables of each document as a web page."""
        tables = self.store.read("chunks").filter("is_table")
        tables = tables.select("doc_id", "page", F.col("chunk_id").alias("table_id"), "table_meta.headers", "table_meta.rows")
        return reports.export_html(self.images(), tables, title)
