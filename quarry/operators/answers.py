"""From results to an answer: context, citations, prompt, template answer, figure references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.render import cut, figure_description, filled
from quarry.operators.history import told

NOTHING = "No relevant information was found in the documents for this question."
NOTE = "[Note: this answer was put together from a template.]"


def context_block(place: Column) -> Column:
    """One numbered block of context of a result row."""
    page = F.col("page").cast("string")
    head = lambda kind: F.concat(F.lit(f"[{kind} "), place.cast("string"), F.lit(" - Page "), page, F.lit("]\n"), F.col("text"))
    more = F.coalesce(F.concat(F.lit("\n\nRelated Context:\n"), F.substring(filled(F.col("related_text_content")), 1, 500)), F.lit(""))
    html = F.coalesce(F.concat(F.lit("\n\nTable HTML:\n"), filled(F.col("table_html"))), F.lit(""))
    return F.when(F.col("is_table"), F.concat(head("Table"), more, html)).otherwise(head("Document"))


def contexts(results: DataFrame) -> DataFrame:
    """(query_id, context, citations) of results (query_id, rank, text, page, section_heading, is_table;
    related_text_content and table_html where there are any)."""
    for c in ("related_text_content", "table_html"):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(""))
    cited = F.struct("rank", cut(F.col("text"), 500).alias("text"), "page", F.col("section_heading").alias("section"), "is_table")
    rows = results.select("query_id", F.struct("rank", context_block(F.col("rank")).alias("block")).alias("b"), cited.alias("c"))
    out = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("b"), F.array_sort(F.collect_list("c")).alias("citations"))
    return out.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"), "citations")


def figure_contexts(images: DataFrame) -> DataFrame:
    """(query_id, figures): descriptions of image results in order of rank."""
    one = F.struct("rank", figure_description(F.col("page"), F.col("vlm_caption"), F.col("ocr_text")).alias("d"))
    out = images.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("f"))
    return out.select("query_id", F.transform("f", lambda x: x["d"]).alias("figures"))


def prompt(query: Column, context: Column, figures: Column, history: Column | None = None) -> Column:
    """What a language model is asked: rules, context, figures, what was said before, and the question."""
    listed = F.when(F.size(figures) > 0, F.concat(F.lit("\n\nFIGURES:\n"), F.array_join(F.transform(figures, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    rules = "INSTRUCTIONS: Answer from the context alone. Cite the page of every statement as [Page X]. Say so if the context has no answer. Name figures that help."
    before = F.lit("") if history is None else F.when(F.size(history) > 0, F.concat(F.lit("\n\nCONVERSATION:\n"), told(history))).otherwise("")
    return F.concat(F.lit(f"{rules}\n\nCONTEXT:\n"), context, listed, before, F.lit("\n\nQUESTION: "), query, F.lit("\n\nANSWER:"))


def template_answer(context: Column, figures: Column) -> Column:
    """The beginning of the context and the number of figures, for use without a language model."""
    first = F.element_at(F.split(context, "\n\n"), 1)
    lead = F.when(context != "", F.when(F.length(first) > 100, F.concat(F.substring(first, 1, 500), F.lit("..."))).otherwise(first))
    shown = F.when(F.size(figures) > 0, F.concat(F.lit("\n\nRelevant figures are available: "), F.size(figures).cast("string"), F.lit(" figure(s) found.")))
    return F.when(lead.isNull() & shown.isNull(), F.lit(NOTHING)).otherwise(F.concat(F.concat_ws("\n", lead, shown), F.lit(f"\n\n{NOTE}")))


def figure_numbers(answer: Column) -> Column:
    found = F.regexp_extract_all(answer, F.lit(r"(?i)(?:figure\s+|fig\.\s*|fig\s+)(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def page_numbers(answer: Column) -> Column:
    found = F.regexp_extract_all(answer, F.lit(r"[Pp]age\s+(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def figure_references(answers: DataFrame, result_pages: DataFrame | None = None) -> DataFrame:
    """(query_id, figure_number, page): every figure of an answer with every page it names, or, if it
    names none, with the pages of the text results (query_id, page). A doc_id of answers is kept."""
    more = [c for c in ("doc_id",) if c in answers.columns]
    rows = answers.select("query_id", *more, figure_numbers(F.col("answer")).alias("figures"), page_numbers(F.col("answer")).alias("pages")).filter(F.size("figures") > 0)
    if result_pages is not None:
        known = result_pages.filter("page > 0").groupBy("query_id").agg(F.array_sort(F.collect_set("page")).alias("known"))
        rows = rows.join(known, "query_id", "left")
        rows = rows.withColumn("pages", F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.coalesce("known", F.array().cast("array<int>"))))
    rows = rows.select("query_id", *more, F.explode("figures").alias("figure_number"), "pages")
    return rows.select("query_id", *more, "figure_number", F.explode("pages").alias("page"))


def resolve_figures(references: DataFrame, images: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(query_id, image_id, page, caption): the images that figure references stand for.

    Per reference, in order of figure and page: the first image of the page not referred to yet whose
    caption or surroundings name the figure, or whose position on the page is its number; else all the
    others of the page. shown: (query_id, image_id) that are referred to already. Where references have a
    doc_id the page is that document's; only the images of pages referred to are read. The references of a
    query are one row, folded in order with the images that are taken so far as the state.
    """
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("id"))
    pool = images.select("doc_id", "page", F.col("id").cast("string").alias("image_id"), place.alias("position"), F.lower(F.coalesce("vlm_caption", F.lit(""))).alias("caption"), F.lower(F.coalesce("surrounding_context", F.lit(""))).alias("around"))
    rows = references.join(pool, ["doc_id", "page"]) if "doc_id" in references.columns else references.join(pool, "page")
    named = lambda c: F.regexp_like(F.col(c), F.concat(F.lit(r"fig(ure|\.)? "), F.col("figure_number").cast("string")))
    rows = rows.select("query_id", "figure_number", "doc_id", "page", "position", "image_id", (named("caption") | named("around") | (F.col("position") == F.col("figure_number"))).alias("fits"))
    if shown is not None:
        rows = rows.join(shown.select("query_id", F.col("image_id").cast("string")), ["query_id", "image_id"], "left_anti")

    # images of no document come last, by id alone
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("position")).alias("position"), "image_id", "fits")
    refs = rows.groupBy("query_id", "figure_number", "page").agg(F.array_sort(F.collect_list(order)).alias("l"))
    names = lambda some: F.transform(some, lambda x: x["image_id"])
    refs = refs.select("query_id", "figure_number", "page", names(F.col("l")).alias("every"), names(F.filter("l", lambda x: x["fits"])).alias("fits"))
    refs = refs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("figure_number", "page", "every", "fits"))).alias("refs"))

    def step(a: Column, r: Column) -> Column:
        hit = F.slice(F.array_except(r["fits"], a["used"]), 1, 1)
        figure = F.concat(F.lit("Figure "), r["figure_number"].cast("string"))
        caption = F.when(F.size(hit) > 0, figure).otherwise(F.concat(figure, F.lit(" on page "), r["page"].cast("string")))
        ids = F.when(F.size(hit) > 0, hit).otherwise(F.array_except(r["every"], a["used"]))
        found = F.struct(ids.alias("ids"), r["page"].alias("page"), caption.alias("caption"))
        return F.struct(F.concat(a["used"], ids).alias("used"), F.concat(a["out"], F.array(found)).alias("out"))

    kind = f"array<struct<ids: array<string>, page: {refs.schema['refs'].dataType.elementType['page'].dataType.simpleString()}, caption: string>>"
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(kind).alias("out"))
    found = refs.select("query_id", F.inline(F.aggregate("refs", start, step, lambda a: a["out"])))
    return found.select("query_id", F.explode("ids").alias("image_id"), "page", "caption")


def image_references(images: DataFrame) -> DataFrame:
    """(query_id, image_id, page, caption): image results as they are shown beside an answer."""
    return images.select("query_id", F.col("id").cast("string").alias("image_id"), "page", F.coalesce("vlm_caption", F.lit("")).alias("caption"))
