"""Web pages as a source: blocks of headings and paragraphs, by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip


def _plain(markup: Column) -> Column:
    text = F.regexp_replace(markup, r"<[^>]*>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return strip(F.regexp_replace(text, r"\s+", " "))


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, idx, text): closed h1 and p elements with their text."""
    found = F.regexp_extract_all("html", F.lit(r"<(?:h1|p)>(.*?)</(?:h1|p)>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("idx", "markup"))
    return rows.select("page_id", "idx", _plain(F.col("markup")).alias("text")).filter("text <> ''")


def file_names(pages: DataFrame) -> DataFrame:
    """(page_id, filename): the last part of the url's path."""
    return pages.select("page_id", F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1).alias("filename"))
