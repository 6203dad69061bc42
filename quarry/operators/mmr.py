"""Maximal marginal relevance: greedy choice of relevant and mutually different results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import jaccard, token_set

LAMBDA = 0.5


def select(results: DataFrame, k: int, trade: float = LAMBDA) -> DataFrame:
    """k of each query's results: the first, then always the one of largest
    trade * relevance - (1 - trade) * similarity to the chosen, earlier ones first on ties.

    results: query_id, id, rank, text, hybrid_score, rerank_score. k steps of windows over the query's
    few results; with k or fewer of them all stay in their order.
    """
    w, first = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy
    rows = results.withColumn("relevance", F.coalesce("rerank_score", "hybrid_score")).withColumn("set", token_set(F.col("text")))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(first("rank", "id")))
    rows = rows.withColumn("pick", F.when((F.col("n") <= k) | (F.col("place") == 1), F.col("place"))).withColumn("near", F.lit(0.0))
    for step in range(2, k + 1):
        last = F.first(F.when(F.col("pick") == step - 1, F.col("set")), ignorenulls=True).over(w)
        rows = rows.withColumn("last", last)
        rows = rows.withColumn("near", F.greatest("near", F.coalesce(jaccard(F.col("set"), F.col("last")), F.lit(0.0))))
        worth = F.round(trade * F.col("relevance") - (1 - trade) * F.col("near"), 9)
        rows = rows.withColumn("turn", F.row_number().over(first(F.col("pick").isNotNull(), worth.desc(), "place")))
        rows = rows.withColumn("pick", F.when(F.col("pick").isNull() & (F.col("turn") == 1) & (F.col("n") > k), F.lit(step)).otherwise(F.col("pick")))
    kept = rows.filter(F.col("pick") <= k).withColumn("rank", F.col("pick"))
    return kept.drop("relevance", "set", "n", "place", "pick", "near", "last", "turn")
