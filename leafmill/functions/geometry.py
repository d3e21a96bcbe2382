"""Rectangle and line geometry as column expressions.

A rectangle is four columns left, top, width, height (integers), named by a
prefix: ``rect("a_")`` is ``a_l, a_t, a_w, a_h``. Everything here stays inside
whole-stage code generation and pushes down as plain arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    l: Column  # noqa: E741
    t: Column
    w: Column
    h: Column

    @property
    def r(self) -> Column:
        return self.l + self.w

    @property
    def b(self) -> Column:
        return self.t + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def x_center(self) -> Column:
        return self.l + truncated(self.w / 2)

    @property
    def y_center(self) -> Column:
        return self.t + truncated(self.h / 2)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.cast("int").alias(prefix + n) for n, c in zip("ltwh", (self.l, self.t, self.w, self.h))]


def rect(prefix: str = "") -> Rect:
    return Rect(*(F.col(prefix + n) for n in "ltwh"))


def truncated(x: Column) -> Column:
    """Towards zero, as integer coordinates are cut."""
    return x.cast("int")


def contains(a: Rect, b: Rect) -> Column:
    return (a.l <= b.l) & (a.t <= b.t) & (a.r >= b.r) & (a.b >= b.b)


def horizontal_overlap(a: Rect, b: Rect) -> Column:
    return F.greatest(F.lit(0), F.least(a.r, b.r) - F.greatest(a.l, b.l))


def vertical_overlap(a: Rect, b: Rect) -> Column:
    return F.greatest(F.lit(0), F.least(a.b, b.b) - F.greatest(a.t, b.t))


def intersection_area(a: Rect, b: Rect) -> Column:
    return horizontal_overlap(a, b) * vertical_overlap(a, b)


def overlap_share(a: Rect, b: Rect) -> Column:
    """Intersection over the area of ``a``; null for an empty ``a``."""
    return intersection_area(a, b) / F.nullif(a.area, F.lit(0))


def intersection(a: Rect, b: Rect) -> Rect:
    """Null columns unless the common area is positive."""
    meets = intersection_area(a, b) > 0
    left, top = F.greatest(a.l, b.l), F.greatest(a.t, b.t)
    return Rect(*(F.when(meets, c) for c in (left, top, F.least(a.r, b.r) - left, F.least(a.b, b.b) - top)))


def union_box(a: Rect, b: Rect) -> Rect:
    left, top = F.least(a.l, b.l), F.least(a.t, b.t)
    return Rect(left, top, F.greatest(a.r, b.r) - left, F.greatest(a.b, b.b) - top)


def union_area(a: Rect, b: Rect) -> Column:
    return a.area + b.area - intersection_area(a, b)


def iou(a: Rect, b: Rect) -> Column:
    return intersection_area(a, b) / F.nullif(union_area(a, b), F.lit(0))


def overlaps(a: Rect, b: Rect) -> Column:
    return (a.l < b.r) & (b.l < a.r) & (a.t < b.b) & (b.t < a.b)


def within_vertically(a: Rect, b: Rect) -> Column:
    """Whether more than half of ``a``'s height lies in ``b``."""
    return vertical_overlap(a, b) * 2 > a.h


def within_horizontally(a: Rect, b: Rect) -> Column:
    """Whether more than half of ``a``'s width lies in ``b``, in either direction of writing."""
    return horizontal_overlap(a, b) * 2 > a.w


def vertical_order(a: Rect) -> list[Column]:
    return [a.t.asc(), a.b.asc()]


def horizontal_order(a: Rect, left_to_right: bool) -> list[Column]:
    return [a.l.asc(), a.r.asc()] if left_to_right else [a.r.desc(), a.l.desc()]


def plain_order(a: Rect, left_to_right: bool) -> list[Column]:
    """A total order where reading order isn't one: down, then along the line."""
    return [*vertical_order(a), *horizontal_order(a, left_to_right)]


def translated(a: Rect, dx: Column, dy: Column) -> Rect:
    return Rect(a.l + dx, a.t + dy, a.w, a.h)


def rescaled(a: Rect, scale: Column) -> Rect:
    return Rect(*(truncated(c * scale) for c in (a.l, a.t, a.w, a.h)))


def rotated_point(x: Column, y: Column, degrees: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """A point turned about the page's centre."""
    angle, cx, cy = F.radians(degrees), width / 2, height / 2
    dx, dy = x - cx, y - cy
    return truncated(dx * F.cos(angle) - dy * F.sin(angle) + cx), truncated(dx * F.sin(angle) + dy * F.cos(angle) + cy)


def rotated(a: Rect, degrees: Column, width: Column, height: Column) -> Rect:
    """The box of two turned corners; it is not boxed anew."""
    x1, y1 = rotated_point(a.l, a.t, degrees, width, height)
    x2, y2 = rotated_point(a.r, a.b, degrees, width, height)
    return Rect(x1, y1, x2 - x1, y2 - y1)


def corner_box(xc: Column, yc: Column, w: Column, h: Column) -> Rect:
    """From a box given by its centre, with integer halves."""
    return Rect(xc - F.floor(w / 2).cast("int"), yc - F.floor(h / 2).cast("int"), w, h)


def cropped_area(area: Rect, width: Column, height: Column, margin: float) -> Rect:
    """A print area with a margin of the page's size on every side, within the page."""
    dx, dy = truncated(width * margin), truncated(height * margin)
    left, top = F.greatest(F.lit(0), area.l - dx), F.greatest(F.lit(0), area.t - dy)
    return Rect(left, top, F.least(width, area.r + dx) - left, F.least(height, area.b + dy) - top)


def tiles(width: Column, height: Column, columns: int, rows: int, margin: float) -> Column:
    """Array of tile structs (x, y, l, t, w, h), column by column, each with a margin and clipped to the frame."""
    tw, th = truncated(width / columns), truncated(height / rows)
    mx, my = truncated(tw * margin), truncated(th * margin)

    def tile(x: Column, y: Column) -> Column:
        left, top = F.greatest(F.lit(0), x * tw - mx), F.greatest(F.lit(0), y * th - my)
        right, bottom = F.least(width, (x + 1) * tw + mx), F.least(height, (y + 1) * th + my)
        return F.struct(x.alias("x"), y.alias("y"), left.alias("l"), top.alias("t"), (right - left).alias("w"), (bottom - top).alias("h"))

    grid = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda x: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda y: tile(x, y)))
    return F.flatten(grid)


def fitted_size(width: Column, height: Column, most_width: int, most_height: int) -> tuple[Column, Column]:
    """Size within bounds that keeps the aspect ratio and is never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(most_width) / width, F.lit(most_height) / height)
    return truncated(width * scale), truncated(height * scale)


def horizontal_span(x1: Column, x2: Column) -> Column:
    """Length of a baseline along the page."""
    return F.abs(x2 - x1)


def vertical_span(y1: Column, y2: Column) -> Column:
    return F.abs(y2 - y1)


def lines_meet(a1: Column, a2: Column, b1: Column, b2: Column, most_gap: int = 0) -> Column:
    """Whether two baselines lie within ``most_gap`` of each other along the page."""
    return F.greatest(F.least(a1, a2), F.least(b1, b2)) - F.least(F.greatest(a1, a2), F.greatest(b1, b2)) <= most_gap
