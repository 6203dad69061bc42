"""Linking of images and tables to text on the same page of the same document, captions and surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.geometry import distance, nearness, overlap
from quarry.functions.text import strip

#: A page is known by its document and number.
PAGE = ["doc_id", "page"]
NEAREST, SHOWN = 3, 500
CAPTION_BELOW, CAPTION_MOST, MARGIN = 100.0, 200, 50.0


def nearby(targets: DataFrame, chunks: DataFrame, n: int = NEAREST) -> DataFrame:
    """(target_id, place, chunk_id, text, section_heading, distance, overlap): the n nearest chunks on the page.

    targets: target_id, doc_id, page, bbox. chunks: id, doc_id, page, text, section_heading, bbox. Without a box the
    first chunks of the page are taken, with null distance and overlap.
    """
    met = targets.join(chunks.select(*PAGE, F.col("id").alias("chunk_id"), "text", "section_heading", F.col("bbox").alias("chunk_box")), PAGE)
    score = F.when(F.col("bbox").isNotNull(), F.round(nearness(F.col("bbox"), F.col("chunk_box")), 9))
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(score.asc_nulls_last(), "chunk_id"))
    out = met.withColumn("place", place).filter(F.col("place") <= n)
    both = F.col("bbox").isNotNull() & F.col("chunk_box").isNotNull()
    return out.select(
        "target_id",
        "place",
        "chunk_id",
        F.substring("text", 1, SHOWN).alias("text"),
        "section_heading",
        F.when(both, distance(F.col("bbox"), F.col("chunk_box"))).alias("distance"),
        F.when(both, overlap(F.col("bbox"), F.col("chunk_box"))).alias("overlap"),
    )


def related(found: DataFrame) -> DataFrame:
    """(target_id, related, related_chunk_ids): the near chunks of each target in order."""
    one = F.struct("place", "chunk_id", "text", "section_heading", "distance", "overlap")
    out = found.groupBy("target_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    fields = lambda x: F.struct(*[x[c].alias(c) for c in ("chunk_id", "text", "section_heading", "distance", "overlap")])
    return out.select("target_id", F.transform("rows", fields).alias("related"), F.transform("rows", lambda x: x["chunk_id"]).alias("related_chunk_ids"))


def reverse_links(chunks: DataFrame, found: DataFrame, name: str = "linked_image_ids") -> DataFrame:
    """chunks with the ids of the targets that are linked to them; an empty array for none."""
    back = found.groupBy(F.col("chunk_id").alias("id")).agg(F.array_sort(F.collect_list("target_id")).alias(name))
    return chunks.join(back, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(found.select(F.array("target_id")).schema[0].dataType)))


def captions(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """(target_id, caption): the first short block just below the box that begins like a caption."""
    start = F.lower(strip(F.col("text"))).rlike(r"^(figure|fig\.|fig )")
    below = (F.col("bbox.y1") <= F.col("block_box.y0")) & (F.col("block_box.y0") <= F.col("bbox.y1") + CAPTION_BELOW)
    b = blocks.select(*PAGE, "idx", "text", F.col("bbox").alias("block_box")).filter(start & (F.length("text") < CAPTION_MOST))
    met = targets.filter("bbox IS NOT NULL").join(b, PAGE).filter(below)
    place = F.row_number().over(Window.partitionBy("target_id").orderBy("idx"))
    first = met.withColumn("place", place).filter("place = 1").select("target_id", strip(F.col("text")).alias("caption"))
    return targets.select("target_id").join(first, "target_id", "left")


def surroundings(targets: DataFrame, blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(target_id, before_text, after_text, surrounding_context): blocks of the page well above and well
    below the top of the box. Without a box the page's lines are halved: those of pages (doc_id, page,
    text), or else of its blocks in order. surrounding_context is both, stripped."""
    b = blocks.select(*PAGE, "idx", "text", F.col("bbox.y0").alias("y"))
    met = targets.filter("bbox IS NOT NULL").join(b, PAGE)
    side = F.when(F.col("y") < F.col("bbox.y0") - MARGIN, "before").when(F.col("y") > F.col("bbox.y0") + MARGIN, "after")
    met = met.withColumn("side", side).filter("side IS NOT NULL")
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["text"]), "\n")
    text = lambda s: joined(F.collect_list(F.when(F.col("side") == s, F.struct("idx", "text"))))
    out = met.groupBy("target_id").agg(text("before").alias("before_text"), text("after").alias("after_text"))
    if pages is None:
        pages = blocks.groupBy(*PAGE).agg(joined(F.collect_list(F.struct("idx", "text"))).alias("text"))
    lines = F.split("text", "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    halves = pages.select(*PAGE, F.array_join(F.slice(lines, F.lit(1), half), "\n").alias("before_text"), F.array_join(F.slice(lines, half + 1, F.size(lines) - half), "\n").alias("after_text"))
    rest = targets.filter("bbox IS NULL").join(halves, PAGE).select("target_id", "before_text", "after_text")
    out = targets.select("target_id").join(out.unionByName(rest), "target_id", "left").fillna("", ["before_text", "after_text"])
    return out.withColumn("surrounding_context", strip(F.concat("before_text", F.lit("\n\n"), "after_text")))
