"""Column functions that render results: captions, citations, tables, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(text: Column, n: int, more: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(more))).otherwise(text)


def filled(text: Column) -> Column:
    """Null for the empty string."""
    return F.when(text != "", text)


def citation(is_table: Column, page: Column, section: Column, text: Column) -> Column:
    kind = F.when(is_table, "Table").otherwise("Document")
    where = F.coalesce(F.concat(F.lit(" ["), filled(section), F.lit("]")), F.lit(""))
    return F.concat(kind, F.lit(" on Page "), page.cast("string"), where, F.lit(": "), cut(text, 300))


def image_caption(page: Column, caption: Column, ocr: Column) -> Column:
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Page "), page.cast("string")),
        F.concat(F.lit("Caption: "), filled(caption)),
        F.concat(F.lit("OCR: "), cut(filled(ocr), 100)),
    )


def figure_description(page: Column, caption: Column, ocr: Column) -> Column:
    return F.concat(
        F.lit("Figure on page "),
        page.cast("string"),
        F.coalesce(F.concat(F.lit(": "), filled(caption)), F.lit("")),
        F.coalesce(F.concat(F.lit(" (OCR: "), F.substring(filled(ocr), 1, 100), F.lit(")")), F.lit("")),
    )


def related_lines(related: Column, n: int = 100) -> Column:
    """One line per related chunk (struct with section_heading and text)."""

    def line(c: Column) -> Column:
        return F.concat(F.coalesce(F.concat(F.lit("["), filled(c["section_heading"]), F.lit("] ")), F.lit("")), cut(c["text"], n))

    return F.transform(related, line)


def related_content(related: Column) -> Column:
    """Related chunks one after the other, each under its section."""

    def block(c: Column) -> Column:
        return F.concat(F.coalesce(F.concat(F.lit("["), filled(c["section_heading"]), F.lit("]\n")), F.lit("")), c["text"])

    return F.array_join(F.transform(related, block), "\n\n")


def markdown(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.transform(headers, lambda _: F.lit("---"))
    return F.array_join(F.concat(F.array(line(headers), line(rule)), F.transform(rows, line)), "\n")


def csv(headers: Column, rows: Column) -> Column:
    def cell(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    line = lambda cells: F.array_join(F.transform(cells, cell), ",")
    return F.concat(F.array_join(F.concat(F.array(line(headers)), F.transform(rows, line)), "\n"), F.lit("\n"))


def html_table(headers: Column, rows: Column) -> Column:
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), safe(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), row(headers, "th"), F.array_join(F.transform(rows, lambda r: row(r, "td")), ""), F.lit("</table>"))


def table_text(page: Column, headers: Column, rows: Column, shown: int = 5) -> Column:
    """A table as searchable text: heading, columns, markdown, first rows."""
    some = lambda cells: F.filter(cells, lambda c: c.isNotNull() & (c != ""))
    numbered = F.transform(F.slice(rows, 1, shown), lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(some(r), " | ")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[TABLE on Page "), page.cast("string"), F.lit("]")),
        F.concat(F.lit("Table with columns: "), F.array_join(some(headers), ", ")),
        markdown(headers, rows),
        filled(F.array_join(numbered, "\n")),
    )


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(height > 0, F.format_string("%.2f", width / height)).otherwise("N/A")


def data_uri(data: Column, kind: str = "png") -> Column:
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(data))


def _or(name: str, have: set[str], other, kind: str | None = None) -> Column:
    """The column, or what stands for it where it is null or missing."""
    value = F.coalesce(F.col(name), F.lit(other)) if name in have else F.lit(other)
    return value.cast(kind) if kind else value


def _related(have: set[str]) -> Column:
    empty = F.array().cast("array<struct<section_heading: string, text: string>>")
    if "related" not in have:
        return empty
    return F.coalesce(F.transform("related", lambda c: F.struct(c["section_heading"].alias("section_heading"), c["text"].alias("text"))), empty)


def shown_image(columns: list[str]) -> Column:
    """An image result as it is shown: every field there, missing ones with their defaults."""
    h = set(columns)
    return F.struct(
        _or("image_path", h, "").alias("image"),
        F.col("id").cast("string").alias("image_id"),
        _or("vlm_caption", h, "").alias("caption"),
        _or("ocr_text", h, "").alias("ocr_text"),
        related_lines(_related(h)).alias("context"),
        _or("page", h, 0, "int").alias("page"),
        _or("score", h, 0.0, "double").alias("score"),
        _or("search_method", h, "unknown").alias("search_method"),
    )


def shown_table(columns: list[str]) -> Column:
    """A table result as it is shown; its score is that of the reranker, or else the hybrid one."""
    h = set(columns)
    scores = [F.col(c) for c in ("rerank_score", "hybrid_score") if c in h]
    meta = lambda c, other: F.coalesce(F.col(f"table_meta.{c}"), F.lit(other)) if "table_meta" in h else F.lit(other)
    return F.struct(
        F.col("id").cast("string").alias("table_id"),
        _or("text", h, "").alias("text"),
        _or("page", h, 0, "int").alias("page"),
        _or("section_heading", h, "").alias("section"),
        related_lines(_related(h)).alias("context"),
        meta("html", "").alias("table_html"),
        meta("markdown", "").alias("table_markdown"),
        meta("num_rows", 0).alias("num_rows"),
        meta("num_cols", 0).alias("num_cols"),
        F.coalesce(*scores, F.lit(0.0)).alias("score"),
    )


def metadata_summary(columns: list[str]) -> Column:
    """What a result has: flags and the number of related chunks."""
    h = set(columns)
    n = F.size(_related(h))
    some = lambda c: _or(c, h, "") != ""
    return F.struct(
        F.col("id").cast("string").alias("id"),
        _or("page", h, 0, "int").alias("page"),
        _or("section_heading", h, "").alias("section"),
        (n > 0).alias("has_related_chunks"),
        n.alias("num_related_chunks"),
        some("vlm_caption").alias("has_vlm_caption"),
        some("ocr_text").alias("has_ocr"),
        _or("is_table", h, False).alias("is_table"),
    )
