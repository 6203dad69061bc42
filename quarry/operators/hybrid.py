"""Fusion of dense and sparse search, with boosts, cuts, filters and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import is_table_query
from quarry.operators import bm25, centroids, dense, inverted
from quarry.operators.common import broadcast_if_small, ranked

#: Weights of the two scores, boost of tables, and how much more each step fetches.
DENSE_WEIGHT, SPARSE_WEIGHT, TABLE_BOOST = 0.6, 0.4, 1.5
FETCH, KEEP = 3, 2
#: Hits of all queries up to which they are sent to the chunks.
MOST_HITS = 10_000


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame) -> DataFrame:
    """Full outer join of the two lists; a missing score is 0."""
    out = dense_hits.select("query_id", "id", "dense_score").join(sparse_hits.select("query_id", "id", "bm25_score"), ["query_id", "id"], "full_outer")
    return out.fillna(0.0, ["dense_score", "bm25_score"])


def weigh(candidates: DataFrame, queries: DataFrame, boost_tables: bool = True) -> DataFrame:
    """hybrid_score from scores divided by the query's largest (1 if that is 0); tables weigh more in table queries."""
    w = Window.partitionBy("query_id")
    part = lambda c: F.col(c) / F.coalesce(F.nullif(F.max(c).over(w), F.lit(0.0)), F.lit(1.0))
    out = candidates.withColumn("hybrid_score", DENSE_WEIGHT * part("dense_score") + SPARSE_WEIGHT * part("bm25_score"))
    if boost_tables:
        asked = broadcast_if_small(queries.select("query_id", is_table_query(F.col("query")).alias("wants_tables")))
        out = out.join(asked, "query_id", "left")
        boosted = F.coalesce(F.col("wants_tables") & F.col("is_table"), F.lit(False))
        out = out.withColumn("hybrid_score", F.when(boosted, F.col("hybrid_score") * TABLE_BOOST).otherwise(F.col("hybrid_score"))).drop("wants_tables")
    return out


def _with_facts(found: DataFrame, chunks: DataFrame, queries: DataFrame, each: int, kept: list[DataFrame]) -> DataFrame:
    """found (query_id, id, dense_score, bm25_score), up to `each` a query, with the attributes of its chunk or nulls. A few
    hits are sent to the chunks, so that no texts are moved but theirs; these hits are kept, so that they are searched once."""
    facts = chunks.select("id", "text", "page", "section_heading", "is_table")
    most = MOST_HITS // each
    if queries.limit(most + 1).count() <= most:
        found = found.persist()
        kept.append(found)
        facts = F.broadcast(facts.join(F.broadcast(found.select("id").distinct()), "id", "left_semi"))
    return found.join(facts, "id", "left")


def search_text(
    chunks: DataFrame,
    vectors: DataFrame | centroids.Centroids,
    queries: DataFrame,
    k: int,
    index: bm25.Index | bm25.Texts | inverted.Inverted | None = None,
    pages: list[int] | None = None,
    sections: list[str] | None = None,
    boost_tables: bool = True,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The k best chunks of each query. Filters act after the cut to KEEP * k, so they may leave fewer.

    rerank adds rerank_score to (query_id, query, id, text); without it hybrid_score decides.
    """
    index = index or bm25.build(chunks)
    near = vectors.search(queries, FETCH * k) if isinstance(vectors, centroids.Centroids) else dense.search(vectors, queries, FETCH * k)
    found = fuse(near, index.search(queries, FETCH * k))
    # dense hits without a chunk keep empty attributes; every sparse hit is a chunk
    found = _with_facts(found, chunks, queries, 2 * FETCH * k, index._kept).fillna({"text": "", "page": 0, "section_heading": "", "is_table": False})
    found = ranked(weigh(found, queries, boost_tables), ["query_id"], "hybrid_score", KEEP * k)
    if pages:
        found = found.filter(F.col("page").isin(pages))
    if sections:
        found = found.filter(F.col("section_heading").isin(sections))
    if rerank is None:
        found = found.withColumn("rerank_score", F.lit(None).cast("double"))
        return ranked(found, ["query_id"], "hybrid_score", k)
    scored = rerank(found.join(queries.select("query_id", "query"), "query_id"))
    scored = scored.withColumn("final_score", F.coalesce("rerank_score", "hybrid_score"))
    return ranked(scored, ["query_id"], "final_score", k).drop("final_score", "query")
