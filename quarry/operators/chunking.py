"""Splitting documents into blocks and chunks, headings and overlaps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import is_heading, paragraphs, strip

LEAST_BLOCK, LEAST_CHUNK = 50, 50
#: Separators in the order in which they are tried.
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", " ")
FIRST_HEADING = "Introduction"


def text_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, chunk_id, idx, text): paragraphs of over LEAST_BLOCK characters; numbers count all."""
    rows = pages.select("doc_id", "page", F.posexplode(paragraphs(F.col("text"))).alias("idx", "text"))
    rows = rows.filter(F.length(strip(F.col("text"))) > LEAST_BLOCK)
    return rows.withColumn("chunk_id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_chunk"), F.col("idx").cast("string")))


def heading_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, heading): the lines that look like headings."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(is_heading(F.col("line"))).select("doc_id", "page", "line_no", strip(F.col("line")).alias("heading"))


def page_headings(pages: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """pages with section_heading: the last heading on the page, else the one carried from earlier pages."""
    lines = F.filter(F.split("text", "\n"), is_heading)
    own = strip(F.element_at(lines, -1))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = pages.withColumn("own_heading", F.when(F.size(lines) > 0, own))
    return out.withColumn("section_heading", F.coalesce(F.last("own_heading", ignorenulls=True).over(w), F.lit(FIRST_HEADING))).drop("own_heading")


def _quote(separator: str) -> str:
    return separator.replace(".", r"\.")


def _mean_piece(text: Column, separator: str) -> Column:
    """Mean length of the pieces that aren't blank, 0 if there are none."""
    total = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"))
    step = lambda a, x: F.when(x.rlike(r"\S"), F.struct((a["n"] + 1).alias("n"), (a["chars"] + F.length(x)).alias("chars"))).otherwise(a)
    return F.aggregate(F.split(text, _quote(separator)), total, step, lambda a: F.when(a["n"] > 0, a["chars"] / a["n"]).otherwise(F.lit(0.0)))


def route(text: Column, size: int) -> Column:
    """Number of the first separator whose pieces have about the wanted size, or null."""
    means = F.array(*[_mean_piece(text, x) for x in SEPARATORS])
    found = F.array_position(F.transform(means, lambda m: (m >= size / 2) & (m <= size * 2)), F.lit(True))
    return F.when(found > 0, (found - 1).cast("int"))


def _not_blank(text: str) -> bool:
    return bool(text.strip(" \t\n\x0b\f\r"))


def pack_pieces(pieces: list[str], size: int, joiner: str) -> list[str]:
    """Neighbouring pieces joined while their lengths together stay within size; joiners don't count."""
    out, open_, n = [], [], 0
    for x in pieces:
        if open_ and n + len(x) > size:
            out.append(joiner.join(open_))
            open_, n = [], 0
        open_.append(x)
        n += len(x)
    return [*out, joiner.join(open_)] if open_ else out


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """The packed pieces of route()'s separator, or windows where no separator fits."""
    for separator in SEPARATORS:
        pieces = [x for x in text.split(separator) if _not_blank(x)]
        if pieces and size / 2 <= sum(map(len, pieces)) / len(pieces) <= size * 2:
            return pack_pieces(pieces, size, separator)
    return split_by_size(text, size, overlap)


def split_by_size(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size`, cut at the last sentence end or else space in them, `overlap` apart; every
    step moves forward."""
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            window = text[start:end]
            cut = window.rfind(". ")
            if cut > 0:
                end = start + cut + 2
            else:
                space = window.rfind(" ")
                if space > 0:
                    end = start + space + 1
        out.append(text[start:end])
        if end >= len(text):
            break
        start = end - overlap if end - overlap > start else end
    return out


def chunk(docs: DataFrame, size: int = 1000, overlap: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """(original_chunk_id, chunk_id, chunk_index, total_chunks, text, page, section_heading) of docs
    (chunk_id, text, page, section_heading): pieces at the best separator, packed up to size, or windows.
    keep: further columns of docs that each chunk gets. Greedy packing and windows go from left to right, so one Arrow function does both in one pass."""

    @F.arrow_udf("array<string>")
    def parts(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else split_text(x, size, overlap) for x in texts.to_pylist()], pa.list_(pa.string()))

    both = docs.filter(F.length(strip(F.col("text"))) >= LEAST_CHUNK).withColumn("parts", parts("text"))
    name = F.coalesce("chunk_id", F.lit("chunk"))
    out = both.select(name.alias("original_chunk_id"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("section_heading", F.lit("")).alias("section_heading"), F.size("parts").alias("total_chunks"), *keep, F.posexplode("parts").alias("chunk_index", "text"))
    out = out.filter(F.length(strip(F.col("text"))) >= LEAST_CHUNK)
    return out.withColumn("chunk_id", F.concat(F.col("original_chunk_id"), F.lit("_"), F.col("chunk_index").cast("string")))


def cut_blocks(blocks: DataFrame, size: int, overlap: int) -> DataFrame:
    """text_blocks() with a section_heading, those over `size` cut as chunk() cuts, all of a page numbered anew."""
    whole = blocks.filter(F.length("text") <= size).withColumn("chunk_index", F.lit(0))
    parts = chunk(blocks.filter(F.length("text") > size), size, overlap, ("doc_id", "idx")).select(*blocks.columns, "chunk_index")
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("idx", "chunk_index")) - 1
    out = whole.unionByName(parts).withColumn("idx", place).drop("chunk_index")
    return out.withColumn("chunk_id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_chunk"), F.col("idx").cast("string")))


def with_overlap(chunks: DataFrame, overlap: int = 200) -> DataFrame:
    """chunks with overlap_prefix and overlap_suffix: the end of the one before, the start of the next; null at the ends."""
    w = Window.partitionBy("original_chunk_id").orderBy("chunk_index")
    return chunks.withColumns({"overlap_prefix": F.right(F.lag("text").over(w), F.lit(overlap)), "overlap_suffix": F.left(F.lead("text").over(w), F.lit(overlap))})
