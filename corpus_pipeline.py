"""A training corpus from documents: the stages in order, each on all that the one before kept.

Columns that the stages don't know pass through all but the last, whatever their names; the columns
doc_id, text, lang, source and n_chars are needed.

Defined results: documents of null text, without letters or in no learned language go (language); rows
that share a doc_id are judged together by the lines and near_copies stages and stay both; rows of null
doc_id keep their lines and are nobody's copies; of equal documents the smallest doc_id stays; a document
that the mix takes several times is several rows; an empty table gives empty tables. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, linededup, mixing, ngramjoin
from quarry.llm.common import fresh_name, materialize, release_since, scratch_mark, table

#: Cosine under which a text resembles none of the learned languages. In langid.DIM dimensions 1,200 made-up
#: texts of letters in scripts that nothing was learned from stay under 0.105, and the least of 2,000 held-out
#: documents has 0.128.
LEAST_COSINE = 0.11


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: texts without letters, and those whose cosine
    with every prototype is under LEAST_COSINE, go."""
    profiles = langid.train(docs.filter(langid.learnable(F.col("doc_id"))))
    name = fresh_name(docs, "language")
    out = langid.identify(docs, profiles, to=name)
    return out.filter((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= LEAST_COSINE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller doc_id has, n_chars counted anew."""
    out = linededup.dedup(docs, to=fresh_name(docs, "lines")).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents, the one of smallest doc_id."""
    name = fresh_name(docs, "similar")
    out = ngramjoin.similar_documents(docs, to=name)
    return out.filter(F.col("doc_id").isNull() | (F.col(f"{name}.class_id") == F.col("doc_id"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in the order of its shards."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, their number, and whether they decode to it."""
    path = bpe.default_vocabulary()
    docs = docs.select("doc_id", "lang", "source", "text")
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]

#: SQL can express neither the trained language ID nor BPE; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again for the next; what a stage had written on
    its way is removed then."""
    docs = table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
            release_since(spark, mark, keep=1)
    return docs
