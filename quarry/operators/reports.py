"""Counts, listings and export filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.render import aspect_ratio, data_uri, html_table

LEAST_SIDE = 50


def page_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("n")).orderBy("page")


def ingest_summary(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """One row: text chunks (tables among them), tables, images, pages."""
    c = chunks.agg(F.count(F.lit(1)).alias("text_chunks"), F.count_if(F.col("is_table")).alias("tables"), F.coalesce(F.max("page"), F.lit(0)).alias("pages"))
    i = images.agg(F.count(F.lit(1)).alias("images"))
    return c.join(F.broadcast(i))  # one row each


def large_enough(images: DataFrame) -> DataFrame:
    """Images of LEAST_SIDE or more on both sides, and those whose sides aren't known."""
    b = F.col("bbox")
    return images.filter(b.isNull() | (b["x1"] - b["x0"] >= LEAST_SIDE) & (b["y1"] - b["y0"] >= LEAST_SIDE))


def positions(rows: DataFrame) -> DataFrame:
    """rows with their 0-based position on the page of their document."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("id")) - 1)


def listing(chunks: DataFrame, n: int = 5, width: int = 200) -> DataFrame:
    """The first n chunks with a preview."""
    return chunks.orderBy("id").limit(n).select("id", "page", "section_heading", F.substring("text", 1, width).alias("preview"))


def _safe(text) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def export_pages(images: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, n_images, n_tables, html): a section of each page, its images (of LEAST_SIDE or more)
    by id, then its tables. images: id, doc_id, page, vlm_caption, bbox, and content where there is one;
    tables: doc_id, page, table_id, headers, rows; tables without rows are left out."""
    shown = F.concat(F.lit("<img src='"), data_uri(F.col("content")), F.lit("'>")) if "content" in images.columns else F.lit("")
    one = F.concat(F.lit("<li>"), F.col("id").cast("string"), F.lit(": "), _safe(F.col("vlm_caption")), F.coalesce(shown, F.lit("")), F.lit("</li>"))
    parts = large_enough(images).select("doc_id", "page", F.lit(0).alias("kind"), F.lpad(F.col("id").cast("string"), 20, "0").alias("key"), one.alias("part"))
    if tables is not None:
        width = F.array_max(F.transform("rows", F.size))
        heads = F.when(F.size("headers") > 0, F.col("headers")).otherwise(F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Column "), i.cast("string"))))
        part = F.concat(F.lit("<li>"), F.col("table_id"), F.lit(": "), html_table(heads, F.col("rows")), F.lit("</li>"))
        some = tables.filter(F.size("rows") > 0)
        parts = parts.unionByName(some.select("doc_id", "page", F.lit(1).alias("kind"), F.col("table_id").alias("key"), part.alias("part")))
    pages = parts.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("kind", "key", "part"))).alias("items"), F.count_if(F.col("kind") == 0).alias("n_images"), F.count_if(F.col("kind") == 1).alias("n_tables"))
    html = F.concat(F.lit("<h2>Page "), F.col("page").cast("string"), F.lit("</h2><ul>"), F.array_join(F.transform("items", lambda x: x["part"]), ""), F.lit("</ul>"))
    return pages.select("doc_id", "page", "n_images", "n_tables", html.alias("html"))


def export_html(images: DataFrame, tables: DataFrame | None = None, title: str = "Content") -> DataFrame:
    """(doc_id, html): a web page of each document's images and tables, with totals, page by page."""
    pages = export_pages(images, tables)
    out = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "html"))).alias("s"), F.sum("n_images").alias("i"), F.sum("n_tables").alias("t"))
    body = F.array_join(F.transform("s", lambda x: x["html"]), "\n")
    totals = F.concat(F.lit("<p>Images: "), F.col("i").cast("string"), F.lit(", tables: "), F.col("t").cast("string"), F.lit("</p>"))
    return out.select("doc_id", F.concat(F.lit(f"<html><head><title>{title}</title></head><body>"), totals, body, F.lit("</body></html>")).alias("html"))


def ocr_report(images: DataFrame, engines: list[str]) -> DataFrame:
    """images (id, page, width, height, bytes, a column of text per engine) with the aspect ratio, the size in
    KB, and for each engine the numbers of characters and words it read, and which read most (null: none)."""
    out = images.withColumns({"aspect_ratio": aspect_ratio(F.col("width"), F.col("height")), "kb": F.format_string("%.2f", F.col("bytes") / 1024)})
    for e in engines:
        text = F.coalesce(F.col(e), F.lit(""))
        out = out.withColumns({f"{e}_chars": F.length(text), f"{e}_words": F.regexp_count(text, F.lit(r"\S+"))})
    most = F.greatest(*[f"{e}_chars" for e in engines], F.lit(0))
    best = F.coalesce(*[F.when((F.col(f"{e}_chars") == most) & (most > 0), F.lit(e)) for e in engines])
    return out.withColumn("best", best).drop(*engines)


def ocr_summary(report: DataFrame, engines: list[str]) -> DataFrame:
    """One row: images, and of each engine how many it read anything in."""
    return report.agg(F.count(F.lit(1)).alias("images"), *[F.count_if(F.col(f"{e}_chars") > 0).alias(f"{e}_read") for e in engines])


def analysis(chunks: DataFrame, images: DataFrame, n: int = 5, width: int = 200, lines: int = 8, captions: int = 10) -> DataFrame:
    """(kind, id, page, preview): the first n text chunks cut to width, the first n tables by their first
    lines, and the captions of the first images, ids in order."""
    texts = chunks.filter("NOT is_table").orderBy("id").limit(n).select(F.lit("text").alias("kind"), "id", "page", F.substring("text", 1, width).alias("preview"))
    tables = chunks.filter("is_table").orderBy("id").limit(n).select(F.lit("table").alias("kind"), "id", "page", F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n").alias("preview"))
    some = images.orderBy("id").limit(captions).select(F.lit("image").alias("kind"), "id", "page", F.coalesce("vlm_caption", F.lit("")).alias("preview"))
    return texts.unionByName(tables).unionByName(some)
