"""Model hooks: batch functions that users put in, with deterministic defaults."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import expand_query

DIMENSION = 64


def hashed_bag(texts: list[str | None], dimension: int = DIMENSION) -> list[list[float] | None]:
    """Unit vectors of signed hashed word counts; null for texts without words."""
    out: list[list[float] | None] = []
    for text in texts:
        v = np.zeros(dimension)
        for w in re.findall(r"\w+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dimension] += 1 if h >> 63 else -1
        n = float(np.sqrt(v @ v))
        out.append((v / n).tolist() if n else None)
    return out


def _none(values: list) -> list:
    return [None] * len(values)


def _empty(values: list) -> list[str]:
    return [""] * len(values)


@dataclass
class Models:
    """embed: texts to vectors; embed_image, ocr, caption: image bytes to vectors or texts; rerank:
    (queries, texts) to scores; generate: prompts to answers. rerank and generate may be None. Each but expand
    may be a function of batches, or Built where it needs something large that a worker should load once."""

    embed: Callable = hashed_bag
    embed_image: Callable = _none
    ocr: Callable = _empty
    caption: Callable = _empty
    rerank: Callable | None = None
    generate: Callable | None = None
    expand: Callable[[Column], Column] = expand_query


@dataclass(frozen=True)
class Built:
    """A model that each worker builds once, by make(), and then asks in batches of `batch` rows. Only make is
    sent to the workers; a worker keeps MOST_BUILT models, those used last."""

    make: Callable[[], Callable]
    batch: int = 64
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


MOST_BUILT = 4
_BUILT: dict[str, Callable] = {}


def _model(f: Callable | Built) -> tuple[Callable, int | None]:
    if not isinstance(f, Built):
        return f, None
    model = _BUILT.pop(f.key, None) or f.make()
    while len(_BUILT) >= MOST_BUILT:
        del _BUILT[next(iter(_BUILT))]
    _BUILT[f.key] = model
    return model, f.batch


def _batch(f: Callable, *columns: list) -> list:
    """f of the columns; if it fails, of their halves, so that one bad row of n costs about 2 log n calls more."""
    n = len(columns[0])
    try:
        return list(f(*columns)) if n else []
    except Exception:
        if n == 1:
            return [None]
        return [x for half in (slice(0, n // 2), slice(n // 2, n)) for x in _batch(f, *(c[half] for c in columns))]


def _answers(f: Callable | Built, *columns: list) -> list:
    model, size = _model(f)
    size = size or len(columns[0]) or 1
    return [x for at in range(0, len(columns[0]), size) for x in _batch(model, *(c[at : at + size] for c in columns))]


def batch_udf(f: Callable | Built, kind: str) -> Callable:
    """A column function of a batch function, or of a model that workers build; a row that fails by itself
    gives null, and costs no other."""
    types = {"string": pa.string(), "array<float>": pa.list_(pa.float32()), "double": pa.float64()}

    @F.arrow_udf(kind)
    def one(a: pa.Array) -> pa.Array:
        return pa.array(_answers(f, a.to_pylist()), types[kind])

    return one


def rerank_with(f: Callable | Built) -> Callable[[DataFrame], DataFrame]:
    """A reranking step for search_text(); if the model fails, scores are null and the order stays."""

    @F.arrow_udf("double")
    def score(queries: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else float(x) for x in _answers(f, queries.to_pylist(), texts.to_pylist())], pa.float64())

    return lambda rows: rows.withColumn("rerank_score", score("query", "text"))


def process_images(images: DataFrame, models: Models) -> DataFrame:
    """images (content, original_caption) with ocr_text, vlm_caption (a real caption wins) and embedding."""
    caption = F.coalesce(F.nullif(F.col("original_caption"), F.lit("")), batch_udf(models.caption, "string")("content"))
    return images.withColumns(
        {
            "ocr_text": F.trim(F.coalesce(batch_udf(models.ocr, "string")("content"), F.lit(""))),
            "vlm_caption": caption,
            "embedding": batch_udf(models.embed_image, "array<float>")("content"),
        }
    )
