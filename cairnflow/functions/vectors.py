"""Vector and box arithmetic."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many dimensions a product with a constant vector is written out, for generated code.
UNROLLED = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine with a constant vector; 0 where either is zero or the vector is null."""
    norm = math.sqrt(sum(x * x for x in query))
    if not norm:
        return F.lit(0.0)
    if len(query) <= UNROLLED:
        parts = [F.get(vector, F.lit(k)).cast("double") for k in range(len(query))]
        product = reduce(add, [p * F.lit(q) for p, q in zip(parts, query, strict=True)])
        length = F.sqrt(reduce(add, [p * p for p in parts]))
    else:
        product, length = dot(vector, F.array(*map(F.lit, query))), F.sqrt(dot(vector, vector))
    return F.coalesce(F.when(length > 0, product / (length * F.lit(norm))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(length > 0, dot(a, b) / length), F.lit(0.0))


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["bottom"] - b["top"])


def box_overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def overlap_share(a: Column, b: Column) -> Column:
    """Shared area as a share of the first box."""
    area = box_area(a)
    return F.when(area > 0, box_overlap(a, b) / area).otherwise(0.0)


def box_iou(a: Column, b: Column) -> Column:
    shared = box_overlap(a, b)
    union = box_area(a) + box_area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def box_distance(a: Column, b: Column) -> Column:
    """Distance between the nearest points of two boxes."""
    dx = F.greatest(b["x0"] - a["x1"], a["x0"] - b["x1"], F.lit(0.0))
    dy = F.greatest(b["top"] - a["bottom"], a["top"] - b["bottom"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def rotated_back(x: Column, y: Column, angle: Column, width: Column, height: Column) -> Column:
    """(x, y) in an image of that size, of a point in the image turned clockwise by 0, 90, 180 or 270 degrees."""
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(angle == 90, at(width - y, x)).when(angle == 180, at(width - x, height - y)).when(angle == 270, at(y, height - x)).otherwise(at(x, y))


def across(a: Column, b: Column) -> Column:
    """Horizontal distance of two boxes: of their facing edges or their middles, whichever is least."""
    middles = F.abs(a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2
    return F.least(F.abs(a["x1"] - b["x0"]), F.abs(a["x0"] - b["x1"]), middles)


def below(a: Column, b: Column) -> Column:
    """How far the middle of ``b`` is below that of ``a``."""
    return (b["top"] + b["bottom"] - a["top"] - a["bottom"]) / 2


def char_width(box: Column, content: Column) -> Column:
    """Whole width of a character of a box's text."""
    return F.floor((box["x1"] - box["x0"]) / F.greatest(F.length(content), F.lit(1)))
