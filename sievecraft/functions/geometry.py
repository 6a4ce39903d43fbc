"""Boxes and points as column expressions. Boxes are x1, y1, x2, y2; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1000


def normalise(value: Column, extent: Column | float, scale: int = SCALE) -> Column:
    """A coordinate as an integer 0 to scale - 1."""
    return F.least(F.greatest(F.bround(value / extent * scale, 0), F.lit(0)), F.lit(scale - 1)).cast("int")


def denormalise(value: Column, extent: Column | float, scale: int = SCALE) -> Column:
    return F.bround(value / scale * extent, 0).cast("int")


def truncated(value: Column, extent: Column | float, scale: int = SCALE) -> Column:
    """The variant that cuts instead of rounding."""
    return (value / extent * scale).cast("int")


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two boxes share."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    return w * h


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    both = overlap(a, b)
    return F.coalesce(F.try_divide(both.cast("double"), (area(*a) + area(*b) - both).cast("double")), F.lit(0.0))


def contains(box: tuple[Column, ...], x: Column, y: Column) -> Column:
    return (box[0] <= x) & (x <= box[2]) & (box[1] <= y) & (y <= box[3])


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def resized(x1: Column, y1: Column, x2: Column, y2: Column, ratio: float = 1.4) -> tuple[Column, ...]:
    """The box grown about its centre, not beyond 0 to 1."""
    dx, dy = (x2 - x1) * (ratio - 1) / 2, (y2 - y1) * (ratio - 1) / 2
    return F.greatest(x1 - dx, F.lit(0.0)), F.greatest(y1 - dy, F.lit(0.0)), F.least(x2 + dx, F.lit(1.0)), F.least(y2 + dy, F.lit(1.0))


def direction(dx: Column, dy: Column) -> Column:
    """Main direction of a move; on equal parts the horizontal one."""
    return F.when(F.abs(dy) > F.abs(dx), F.when(dy > 0, "down").otherwise("up")).otherwise(F.when(dx > 0, "right").otherwise("left"))


def length_class(share: Column, short: float = 0.3, medium: float = 0.5) -> Column:
    """short, medium or long; the cut points are parameters as sources differ in them."""
    return F.when(share < short, "short").when(share < medium, "medium").otherwise("long")


def is_tap(x1: Column, y1: Column, x2: Column, y2: Column, most: float = 0.04) -> Column:
    return distance(x1, y1, x2, y2) <= most


def main_axis(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """y or x, whichever changes more; y on equal parts."""
    return F.when(F.abs(y2 - y1) >= F.abs(x2 - x1), "y").otherwise("x")
