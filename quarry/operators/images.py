"""Image search by vector, by text, and through linked text results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import STOP_WORDS, jaccard, token_set
from quarry.operators import dense
from quarry.operators.common import met, ranked

#: Weights of the three texts, the boost, the score of linked images, thresholds.
CAPTION, OCR, RELATED, BOOST, BOOST_FROM = 0.4, 0.3, 0.3, 1.2, 0.3
LINKED_SCORE, LEAST_FINAL, LEAST_TEXT_RESULT = 0.7, 0.4, 0.5


def vector_hits(images: DataFrame, queries: DataFrame, k: int, least: float = 0.5) -> DataFrame:
    """Images by cosine, 2k fetched, those of `least` or more kept."""
    rows = images.filter("embedding IS NOT NULL").select("id", "embedding")
    return dense.search(rows, queries, 2 * k, "score").filter(F.round("score", 9) >= least).select("query_id", "id", "score")


def text_scores(images: DataFrame, queries: DataFrame) -> DataFrame:
    """Weighted similarity of the query's words, less stop words, with caption, OCR and related text."""
    terms = F.array_except(token_set(F.col("query")), F.array(*[F.lit(w) for w in STOP_WORDS]))
    asked = queries.select("query_id", terms.alias("terms")).filter(F.size("terms") > 0)
    rows = images.select("id", *[token_set(F.col(c)).alias(c) for c in ("vlm_caption", "ocr_text", "related_text_content")])
    part = lambda c: jaccard(F.col("terms"), F.col(c))
    related = part("related_text_content")
    score = CAPTION * part("vlm_caption") + OCR * part("ocr_text") + RELATED * related
    return met(rows, asked).select("query_id", "id", F.when(related > BOOST_FROM, score * BOOST).otherwise(score).alias("score"))


def linked_hits(text_results: DataFrame, links: DataFrame, hits: DataFrame, require_hit: bool = True) -> DataFrame:
    """Images that good text results link to (links: id, image_id); by default only those found by vector too."""
    good = text_results.filter(F.coalesce("rerank_score", "hybrid_score") >= LEAST_TEXT_RESULT)
    out = good.join(links, "id").select("query_id", F.col("image_id").alias("id")).distinct()
    if require_hit:
        out = out.join(hits, ["query_id", "id"], "left_semi")
    return out.withColumn("score", F.lit(LINKED_SCORE))


def search(images: DataFrame, queries: DataFrame, k: int, least_vector: float = 0.5, least_text: float = 0.5, text_results: DataFrame | None = None, links: DataFrame | None = None, require_hit: bool = True) -> DataFrame:
    """The k best images of the three ways; of an image found twice the earlier way counts."""
    hits = vector_hits(images, queries, k, least_vector)
    found = hits.select("query_id", "id", "score", F.lit(1).alias("way"), F.lit("vector").alias("search_method"))
    texts = text_scores(images, queries).filter(F.round("score", 9) >= least_text)
    found = found.unionByName(texts.select("query_id", "id", "score", F.lit(2).alias("way"), F.lit("text_match").alias("search_method")))
    if text_results is not None and links is not None:
        linked = linked_hits(text_results, links, hits, require_hit)
        found = found.unionByName(linked.select("query_id", "id", "score", F.lit(3).alias("way"), F.lit("linked").alias("search_method")))
    once = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("way"))
    found = found.withColumn("once", once).filter("once = 1").filter(F.round("score", 9) >= LEAST_FINAL)
    return ranked(found, ["query_id"], "score", k).select("query_id", "rank", "id", "score", "search_method")
