"""Boxes [x0, y0, x1, y1] as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection over the area of the first box (at least 1e-6)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return w * h / F.greatest((a[2] - a[0]) * (a[3] - a[1]), F.lit(1e-6))


def of_points(points: Column) -> Column:
    """The box around an array of [x, y]; null without points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def union_of(elements: Column) -> Column:
    """struct(bbox, page_size): the union of the boxes of an ordered array of struct(bbox, page_size, ...).

    Only elements with a box and a page size count, and of these only those with the first one's page size; fields are null
    if there is none.
    """

    def sides(found: Column) -> Column:
        size = F.get(found, F.lit(0))["page_size"]
        boxes = F.transform(F.filter(found, lambda e: e["page_size"] == size), lambda e: e["bbox"])
        side = lambda f, i: f(F.transform(boxes, lambda b: b[i]))
        box = F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 2), side(F.array_max, 3))
        return F.struct(F.when(size.isNotNull(), box).alias("bbox"), size.alias("page_size"))

    usable = F.filter(elements, lambda e: e["bbox"].isNotNull() & e["page_size"].isNotNull())
    return F.get(F.transform(F.array(usable), sides), F.lit(0))


def skipped_pages(every: Column, detected: Column) -> Column:
    """Pages that were not detected, in order."""
    return F.sort_array(F.array_except(every, detected))


def visual_pages(figures: Column, vectors: Column) -> Column:
    """Pages with figures or vector visuals, in order."""
    return F.sort_array(F.array_union(figures, vectors))


def adjacent_pages(hits: Column, ahead: int = 2) -> Column:
    """The pages up to `ahead` after those hit, without the hit ones, in order."""
    after = F.flatten(F.transform(hits, lambda p: F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda k: (p + k).cast("int"))))
    return F.sort_array(F.array_except(after, hits))
