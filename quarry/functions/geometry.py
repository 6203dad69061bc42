"""Column functions on boxes: structs of x0, y0, x1, y1, or of a centre x, y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The box of a table that has none, and the page on which boxes are estimated.
TABLE_BOX = (50.0, 200.0, 562.0, 400.0)
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
FAR = 999999.0


def box(x0, y0, x1, y1) -> Column:
    names = ("x0", "y0", "x1", "y1")
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip(names, (x0, y0, x1, y1), strict=True)])


def distance(a: Column, b: Column) -> Column:
    """Between the centres of two boxes."""
    dx = (a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2
    dy = (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that don't meet or are incomplete."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"])
    whole = F.lit(True)
    for c in (a, b):
        for k in ("x0", "y0", "x1", "y1"):
            whole = whole & c[k].isNotNull()
    meet = whole & (w > 0) & (h > 0)
    return F.when(meet, w * h / (area(a) + area(b) - w * h)).otherwise(F.lit(0.0))


def nearness(target: Column, chunk: Column) -> Column:
    """Sort key of nearby chunks: distance, less up to half of it by overlap; FAR without a box."""
    return F.when(chunk.isNull(), F.lit(FAR)).otherwise(distance(target, chunk) * (1 - 0.5 * overlap(target, chunk)))


def estimated_box(text: Column) -> Column:
    """Where a text may stand on a page, from its length alone."""
    n = F.length(text)
    top = PAGE_HEIGHT * 0.1 + (n % 100) * 0.5
    return box(F.lit(PAGE_WIDTH * 0.1), top, F.lit(PAGE_WIDTH * 0.9), top + F.least(n / 10, F.lit(100.0)))
