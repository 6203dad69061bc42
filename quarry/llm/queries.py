"""The queries opN_<name> over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ann, bpe, chat, htmlextract, langid, linededup, maxscore, mixing, ngramjoin, secrets, spelling, urlfilter, whitening
from quarry.llm.common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.word_totals(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, sf_dir, "pages"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.matches(table(spark, sf_dir, "embeddings"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.texts(table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": op1_mix,
        "op2_neighbours": op2_neighbours,
        "op3_language": op3_language,
        "op4_chat": op4_chat,
        "op5_urls": op5_urls,
        "op6_lines": op6_lines,
        "op7_top_k": op7_top_k,
        "op8_main_text": op8_main_text,
        "op9_ngram_join": op9_ngram_join,
        "op10_bpe": op10_bpe,
        "op11_secrets": op11_secrets,
        "op12_whitening": op12_whitening,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; the others are tested against brute force."""
    return {
        "op1_mix": mixing.ORACLE_SQL,
        "op4_chat": chat.ORACLE_SQL,
        "op5_urls": urlfilter.ORACLE_SQL,
        "op6_lines": linededup.ORACLE_SQL,
        "op7_top_k": maxscore.ORACLE_SQL,
        "op9_ngram_join": ngramjoin.ORACLE_SQL,
        "op13_spelling": spelling.ORACLE_SQL,
    }
