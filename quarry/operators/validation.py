"""Rules for image, table and text metadata; each row gets the array of its errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _errors(*rules: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, m if isinstance(m, Column) else F.lit(m)) for bad, m in rules]))


def _page_rules() -> list[tuple[Column, str | Column]]:
    page = F.col("page")
    return [(page.isNull(), "Missing required field: page"), (page < 1, F.concat(F.lit("Invalid page number: "), page.cast("string")))]


def image_errors() -> Column:
    """Of rows with page, image_path, related_text_chunks, related_chunk_ids."""
    chunks, ids = F.col("related_text_chunks"), F.col("related_chunk_ids")
    from_chunks = F.transform(chunks, lambda c: c["chunk_id"])
    same = lambda a: F.array_sort(F.array_distinct(a))
    return _errors(
        *_page_rules(),
        (F.col("image_path").isNull(), "Missing required field: image_path"),
        (F.exists(chunks, lambda c: c["chunk_id"].isNull()), "related_text_chunks has an entry without chunk_id"),
        (F.exists(chunks, lambda c: c["text"].isNull()), "related_text_chunks has an entry without text"),
        (ids.isNotNull() & chunks.isNotNull() & (same(ids) != same(from_chunks)), "related_chunk_ids and related_text_chunks are inconsistent"),
    )


def table_errors() -> Column:
    """Of rows with page, is_table, num_rows, num_cols."""
    return _errors(
        *_page_rules(),
        (F.col("is_table").isNull(), "Missing required field: is_table"),
        (~F.col("is_table"), "Table metadata must have is_table=True"),
        (F.col("num_rows") < 0, "table_metadata.num_rows must be a non-negative integer"),
        (F.col("num_cols") < 0, "table_metadata.num_cols must be a non-negative integer"),
    )


def text_errors() -> Column:
    return _errors(*_page_rules(), (F.coalesce(F.length("text"), F.lit(0)) == 0, "Missing required field: text"))


def errors_by_kind() -> Column:
    """Errors by the rules of the row's kind (image, table or text); another kind is an error itself."""
    unknown = F.array(F.concat(F.lit("Unknown metadata type: "), F.coalesce("kind", F.lit("null"))))
    return F.when(F.col("kind") == "image", image_errors()).when(F.col("kind") == "table", table_errors()).when(F.col("kind") == "text", text_errors()).otherwise(unknown)


def consistency(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id, kind, errors) for every id of a collection: of its metadata by its kind, or that it has none.
    Text chunks are held against the rules for text."""
    checked = metadata.select("id", "kind", errors_by_kind().alias("errors"))
    out = ids.select("id").join(checked, "id", "left")
    return out.withColumn("errors", F.coalesce("errors", F.array(F.lit("No metadata found"))))


def summary(checked: DataFrame) -> DataFrame:
    """One row: total, valid and invalid rows, number of errors."""
    return checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.size("errors") == 0).alias("valid"),
        F.count_if(F.size("errors") > 0).alias("invalid"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("n_errors"),
    )


def parse_metadata(lines: DataFrame, schema: str, name: str = "value") -> DataFrame:
    """JSON metadata to columns; lines that aren't JSON keep their text in _corrupt."""
    parsed = F.from_json(name, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("m")).select("m.*")
