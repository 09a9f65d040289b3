"""Boxes as four numeric columns x1, y1, x2, y2. All functions take and return Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Names a box's columns: ``Box.of("a_")`` is a_x1, a_y1, a_x2, a_y2."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def area(b: Box) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 if the union is empty."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i.cast("double") / u).otherwise(F.lit(0.0))


def center_inside(inner: Box, outer: Box) -> Column:
    """The centre of ``inner`` lies in ``outer``; left and top edges count, right and bottom don't."""
    x, y = center(inner)
    return (x >= outer.x1) & (x < outer.x2) & (y >= outer.y1) & (y < outer.y2)


def clamped(b: Box, width: int, height: int) -> Box:
    """The box within the frame."""
    cut = lambda v, most: F.greatest(F.lit(0), F.least(v, F.lit(most)))
    return Box(cut(b.x1, width), cut(b.y1, height), cut(b.x2, width), cut(b.y2, height))


def whole(b: Box) -> Box:
    """Outward to whole numbers: floor of the minimum, ceiling of the maximum."""
    return Box(F.floor(b.x1), F.floor(b.y1), F.ceil(b.x2), F.ceil(b.y2))


def edge_contacts(b: Box, width: int, height: int) -> list[Column]:
    """Left, top, right, bottom."""
    return [b.x1 <= 0, b.y1 <= 0, b.x2 >= width, b.y2 >= height]


def padded(b: Box, fraction: float, width: int, height: int) -> Box:
    """Grown by a fraction of its size on each side, within the frame."""
    dx, dy = (b.x2 - b.x1) * fraction, (b.y2 - b.y1) * fraction
    return clamped(Box(b.x1 - dx, b.y1 - dy, b.x2 + dx, b.y2 + dy), width, height)


def fraction_roi(b: Box, left: float, top: float, right: float, bottom: float) -> Box:
    """A region given by fractions of the box: floor of the minimum, ceiling of the maximum; an empty side becomes one wide."""
    w, h = b.x2 - b.x1, b.y2 - b.y1
    x1, y1 = b.x1 + F.floor(w * left), b.y1 + F.floor(h * top)
    return Box(x1, y1, F.greatest(b.x1 + F.ceil(w * right), x1 + 1), F.greatest(b.y1 + F.ceil(h * bottom), y1 + 1))


def in_frame(region: Box, crop: Box, width: Column, height: Column) -> Box:
    """A region of a crop that is ``width`` x ``height`` large, in frame coordinates: scaled to the crop's box and moved there.

    Outward to whole numbers and kept within the crop's box.
    """
    sx, sy = (crop.x2 - crop.x1) / width, (crop.y2 - crop.y1) / height
    low = lambda a, r, k: F.greatest(a, a + F.floor(r * k))
    high = lambda a, b, r, k: F.least(b, a + F.ceil(r * k))
    return Box(low(crop.x1, region.x1, sx), low(crop.y1, region.y1, sy), high(crop.x1, crop.x2, region.x2, sx), high(crop.y1, crop.y2, region.y2, sy))


def letterbox(x: Column, y: Column, frame: tuple[int, int], display: tuple[int, int]) -> tuple[Column, Column]:
    """Display coordinates of a frame shown as large as it fits, back to frame coordinates."""
    scale = min(display[0] / frame[0], display[1] / frame[1])
    dx, dy = (display[0] - frame[0] * scale) / 2, (display[1] - frame[1] * scale) / 2
    return (x - dx) / scale, (y - dy) / scale


def temporal_gap(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> Column:
    """Frames between two inclusive spans; 0 if they overlap or touch."""
    return F.when(last_a < first_b, first_b - last_a - 1).when(last_b < first_a, first_a - last_b - 1).otherwise(F.lit(0))


def spans_overlap(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> Column:
    return (first_a <= last_b) & (first_b <= last_a)
