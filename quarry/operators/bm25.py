"""Okapi BM25 over an inverted index of postings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.common import broadcast_if_small, ranked

#: The usual parameters, and the share of the mean idf that replaces negative ones.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words of queries up to which the scan of texts is told which ones it should look for.
MOST_NAMED = 1_000


@dataclass
class Index:
    """postings (term, id, tf, dl), terms (term, df, idf) and one row of statistics (n, avgdl, mean_idf), in
    memory; inverted.Inverted is the stored form."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    _kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give back what build() and searches keep; the index can still be used, at the price of building it anew."""
        for df in (self.postings, *self._kept):
            df.unpersist()
        self._kept.clear()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best of each query, of these the positive ones."""
        return ranked(scores(self, queries), ["query_id"], "bm25_score", k).filter("bm25_score > 0")


class Texts:
    """The same straight from chunks (id, text), for queries that come once: nothing is stored, and postings of words
    that no query has are counted where they are and not moved. One pass over the texts counts the documents of each
    term, of which a row a term and task is moved, and another one scores the queries' words."""

    def __init__(self, chunks: DataFrame):
        words = chunks.select("id", tokens(F.col("text")).alias("words"))  # not filtered, which would cut the texts twice
        # the length before words are dealt to rows, which would carry all words with each otherwise
        self.words = words.select("id", F.size("words").alias("dl"), "words")
        self._kept: list[DataFrame] = []

    def release(self) -> None:
        """Give back what searches keep in memory, which is a row a word of their queries."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    def _weighed(self, queries: DataFrame) -> tuple[DataFrame, float]:
        """(query_id, term, weight), a term's weight being its idf as often as the query has it, and the mean length."""
        wanted = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        first = F.col("at") == 0
        counted = self.words.select("dl", F.posexplode(F.array_distinct("words")).alias("at", "term"))
        counted = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count_if(first).alias("docs"), F.sum(F.when(first, F.col("dl"))).alias("words"))
        # statistics need no more than how many terms have a df
        named = broadcast_if_small(wanted.select(F.col("term"), F.col("term").alias("named")).distinct())
        sizes = counted.join(named, "term", "left").groupBy("named", "df").agg(F.count(F.lit(1)).alias("terms"), F.sum("docs").alias("docs"), F.sum("words").alias("words")).persist()
        n, words = (x or 0 for x in sizes.agg(F.sum("docs"), F.sum("words")).first())
        raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = sizes.agg(F.sum(F.col("terms") * raw) / F.sum("terms")).first()[0] or 0.0
        idf = sizes.filter("named IS NOT NULL").select(F.col("named").alias("term"), F.when(raw < 0, EPSILON * mean).otherwise(raw).alias("idf"))
        out = wanted.join(broadcast_if_small(idf), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")).persist()
        out.count()
        sizes.unpersist()
        self._kept.append(out)
        return out, words / max(n, 1) or 1.0

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, bm25_score) of all documents that hold a term of the query."""
        weighed, mean = self._weighed(queries)
        named = [r[0] for r in weighed.select("term").distinct().limit(MOST_NAMED + 1).collect()]
        # of few words, others are left where they are; more are told apart by the join alone
        words = F.filter("words", lambda w: w.isin(named)) if len(named) <= MOST_NAMED else F.col("words")
        hits = self.words.select("id", "dl", F.explode(words).alias("term")).join(broadcast_if_small(weighed), "term")
        hits = hits.groupBy("query_id", "id", "term", "weight", "dl").agg(F.count(F.lit(1)).alias("tf"))
        part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        return hits.groupBy("query_id", "id").agg(F.sum(part).alias("bm25_score"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best of each query, of these the positive ones."""
        return ranked(self.scores(queries), ["query_id"], "bm25_score", k).filter("bm25_score > 0")


def searchable(chunks: DataFrame) -> DataFrame:
    """(id, text) of chunks as they are indexed: tables with the text related to them."""
    if "related_text_content" not in chunks.columns:
        return chunks.select("id", "text")
    more = F.when(F.col("is_table"), F.col("related_text_content"))
    return chunks.select("id", F.concat_ws(" ", "text", more).alias("text"))


def build(chunks: DataFrame, keep: bool = True) -> Index:
    """Index of chunks (id, text). Chunks without tokens don't count as documents.

    Statistics come from the postings too (the shares tf / dl of a document sum to 1, so that all of
    them sum to the number of documents). Postings are kept (in memory, and on disk beyond it), so that
    the texts are cut into words once; release() the index afterwards.
    """
    words = chunks.select("id", tokens(F.col("text")).alias("words")).filter(F.size("words") > 0)
    postings = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    if keep:
        postings = postings.persist()
    counted = postings.groupBy("term").agg(F.count("id").alias("df"), F.sum("tf").alias("all_tf"), F.sum(F.col("tf") / F.col("dl")).alias("share"))
    totals = counted.agg(F.round(F.sum("share")).cast("long").alias("n"), F.sum("all_tf").alias("words")).select("n", (F.col("words") / F.col("n")).alias("avgdl"))
    raw = counted.join(F.broadcast(totals)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    stats = totals.join(F.broadcast(mean))  # both have one row
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf"))
    return Index(postings, terms, stats)


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, id, bm25_score) of the documents that hold a term of the query; repeats count."""
    wanted = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = broadcast_if_small(wanted)
    terms = index.terms.join(wanted.select("term").distinct(), "term", "left_semi")
    hits = index.postings.join(wanted, "term").join(terms, "term").join(F.broadcast(index.stats.select("avgdl")))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("bm25_score"))
