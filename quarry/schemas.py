"""Schemas of the engine's tables, and the driver's tables in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
RELATED = "array<struct<chunk_id: string, text: string, section_heading: string, distance: double, overlap: double>>"
CHUNKS = "id long, doc_id long, text string, page int, section_heading string, is_table boolean"
#: Schemas of what decoders give.
DECODED_IMAGES = f"doc_id long, page int, image_id string, format string, bbox {BOX}, content binary"
DECODED_TABLES = f"doc_id long, page int, table_id string, headers array<string>, rows array<array<string>>, bbox {BOX}"
#: Rows of the driver's tables that stand for one document of 20 pages.
A_DOCUMENT = 100
IMAGES = "id long, doc_id long, page int, vlm_caption string, ocr_text string, related_text_content string, embedding array<float>, bbox " + BOX
QUERIES = "query_id long, query string, query_vec array<float>"
METADATA_VERSION = "1.1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text chunks: id, doc_id, text, page, section_heading, is_table."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.floor(F.col("doc_id") / A_DOCUMENT).alias("doc_id"),
        "text",
        (1 + F.col("doc_id") % 20).cast("int").alias("page"),
        F.col("source").alias("section_heading"),
        (F.col("doc_id") % 10 == 0).alias("is_table"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as images, with captions and related text from documents and OCR text from benchmark."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("vlm_caption"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("ocr_text"))
    n = F.broadcast(b.agg((F.max("item") + 1).alias("n")))  # one row
    i = e.join(n).join(d, "vec_id", "left").join(b, F.col("vec_id") % F.col("n") == F.col("item"), "left")
    v = F.col("vec_id")
    return i.select(
        v.alias("id"),
        F.floor(v / A_DOCUMENT).alias("doc_id"),
        (1 + v % 20).cast("int").alias("page"),
        F.coalesce("vlm_caption", F.lit("")).alias("vlm_caption"),
        F.coalesce("ocr_text", F.lit("")).alias("ocr_text"),
        F.coalesce("vlm_caption", F.lit("")).alias("related_text_content"),
        "embedding",
        F.struct(*[x.cast("double").alias(n) for n, x in (("x0", v % 300), ("y0", v % 500), ("x1", v % 300 + 120), ("y1", v % 500 + 90))]).alias("bbox"),
    )


def box_of(id_: Column) -> Column:
    """A made-up box for a chunk, by integer arithmetic on its id."""
    return F.struct(*[x.cast("double").alias(n) for n, x in (("x0", id_ % 200), ("y0", id_ * 7 % 600), ("x1", id_ % 200 + 250), ("y1", id_ * 7 % 600 + 80))])


def queries(spark: SparkSession, sf_dir: str, texts: dict[int, tuple[str, int]]) -> DataFrame:
    """(query_id, query, query_vec) of literal texts, with the embedding of a vec_id as vector."""
    rows = spark.createDataFrame([(k, t, v) for k, (t, v) in texts.items()], "query_id long, query string, vec_id long")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    return rows.join(e, "vec_id", "left").select("query_id", "query", "query_vec")
