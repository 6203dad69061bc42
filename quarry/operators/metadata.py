"""Open metadata: JSON sidecars of any fields, as VARIANT, with the known fields as columns of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schemas import METADATA_VERSION

#: The fields that are columns, with their types. A value of another type counts as missing.
KNOWN = {
    "page": "int",
    "text": "string",
    "section_heading": "string",
    "is_table": "boolean",
    "image_path": "string",
    "vlm_caption": "string",
    "ocr_text": "string",
    "related_chunk_ids": "array<string>",
    "related_text_chunks": "array<struct<chunk_id: string, text: string>>",
    "related_text_content": "string",
    "metadata_version": "string",
    "last_updated": "timestamp",
}
#: Fields that came with the present version; metadata of an earlier one get them empty.
SINCE = {"related_text_chunks": "array()", "related_chunk_ids": "array()", "related_text_content": "''"}


def sidecars(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(id, value) of the JSON files below path: the name without its suffix, and the text."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("id"), "value")


def kind() -> Column:
    """table, image or text, by the fields that there are, or else unknown."""
    return F.when(F.col("is_table"), "table").when(F.col("image_path").isNotNull(), "image").when(F.col("text").isNotNull(), "text").otherwise("unknown")


def read(lines: DataFrame) -> DataFrame:
    """lines (id, value) with `state`, `kind`, the KNOWN columns, `others` (the names of all other fields, sorted)
    and `fields`, the whole as VARIANT. state: missing (null), corrupt (not a JSON object), old (of an earlier
    version, brought up to the present one) or current."""
    v = F.try_parse_json("value")
    fields = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    rows = lines.select("id", "value", fields.alias("fields"))
    rows = rows.select("*", *[F.try_variant_get("fields", f"$.{c}", t).alias(c) for c, t in KNOWN.items()])
    old = F.coalesce("metadata_version", F.lit("1.0")) != METADATA_VERSION
    state = F.when(F.col("value").isNull(), "missing").when(F.col("fields").isNull(), "corrupt").when(old, "old").otherwise("current")
    others = F.array_sort(F.array_except(F.coalesce(F.json_object_keys(F.when(F.col("fields").isNotNull(), F.col("value"))), F.array().cast("array<string>")), F.array(*[F.lit(c) for c in KNOWN])))
    rows = rows.withColumns({"state": state, "kind": F.when(F.col("fields").isNotNull(), kind()), "others": others})
    due = F.col("state") == "old"
    migrated = {c: F.when(due, F.coalesce(F.col(c), F.expr(x).cast(KNOWN[c]))).otherwise(F.col(c)) for c, x in SINCE.items()}
    rows = rows.withColumns(migrated | {"metadata_version": F.when(due, METADATA_VERSION).otherwise(F.col("metadata_version"))})
    return rows.select("id", "state", "kind", *KNOWN, "others", "fields")


def field(name: str, kind: str = "string") -> Column:
    """A field of read() that has no column."""
    return F.try_variant_get("fields", f"$.{name}", kind)
