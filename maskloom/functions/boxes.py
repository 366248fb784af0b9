"""Box geometry as column expressions.

Boxes are ARRAY<DOUBLE>, their encoding is in the function's name: ``xywh`` (corner and size), ``xyxy``
(two corners), ``cxcywh`` (centre and size), ``xywha`` (centre, size, angle in degrees, counter-clockwise).
A null box, or one with too few numbers, gives null; everything stays inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def make(*parts: Column) -> Column:
    """An array of the parts; null if any is null."""
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.array(*parts))


def xywh_to_xyxy(b: Column) -> Column:
    return make(at(b, 0), at(b, 1), at(b, 0) + at(b, 2), at(b, 1) + at(b, 3))


def xyxy_to_xywh(b: Column) -> Column:
    return make(at(b, 0), at(b, 1), at(b, 2) - at(b, 0), at(b, 3) - at(b, 1))


def xywh_to_cxcywh(b: Column) -> Column:
    return make(at(b, 0) + at(b, 2) / 2, at(b, 1) + at(b, 3) / 2, at(b, 2), at(b, 3))


def cxcywh_to_xywh(b: Column) -> Column:
    return make(at(b, 0) - at(b, 2) / 2, at(b, 1) - at(b, 3) / 2, at(b, 2), at(b, 3))


def cxcywh_to_xyxy(b: Column) -> Column:
    return make(at(b, 0) - at(b, 2) / 2, at(b, 1) - at(b, 3) / 2, at(b, 0) + at(b, 2) / 2, at(b, 1) + at(b, 3) / 2)


def xyxy_to_cxcywh(b: Column) -> Column:
    return make((at(b, 0) + at(b, 2)) / 2, (at(b, 1) + at(b, 3)) / 2, at(b, 2) - at(b, 0), at(b, 3) - at(b, 1))


def xywh_to_xywha(b: Column) -> Column:
    return make(at(b, 0) + at(b, 2) / 2, at(b, 1) + at(b, 3) / 2, at(b, 2), at(b, 3), F.lit(0.0))


def xywha_to_xyxy(b: Column) -> Column:
    """The upright box around a rotated one."""
    c, s = F.abs(F.cos(F.radians(at(b, 4)))), F.abs(F.sin(F.radians(at(b, 4))))
    w, h = c * at(b, 2) + s * at(b, 3), c * at(b, 3) + s * at(b, 2)
    return make(at(b, 0) - w / 2, at(b, 1) - h / 2, at(b, 0) + w / 2, at(b, 1) + h / 2)


CONVERSIONS = {
    ("xywh", "xyxy"): xywh_to_xyxy,
    ("xyxy", "xywh"): xyxy_to_xywh,
    ("xywh", "cxcywh"): xywh_to_cxcywh,
    ("cxcywh", "xywh"): cxcywh_to_xywh,
    ("cxcywh", "xyxy"): cxcywh_to_xyxy,
    ("xyxy", "cxcywh"): xyxy_to_cxcywh,
    ("xywh", "xywha"): xywh_to_xywha,
    ("xywha", "xyxy"): xywha_to_xyxy,
}


def between(v: Column, low: Column, high: Column) -> Column:
    """``v`` moved into [low, high]; null for null (greatest and least leave nulls out)."""
    return F.when(v.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(v, low), high))


def convert(b: Column, source: str, target: str) -> Column:
    if source == target:
        return b
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"no conversion from {source} to {target}")
    return CONVERSIONS[source, target](b)


def to_relative(b: Column, width: Column, height: Column) -> Column:
    """Coordinates by image size (x and sizes in x by width); null for an empty image."""
    return make(*(F.try_divide(at(b, i), (width if i % 2 == 0 else height).cast("double")) for i in range(4)))


def to_absolute(b: Column, width: Column, height: Column) -> Column:
    return make(*(at(b, i) * (width if i % 2 == 0 else height) for i in range(4)))


def clamp(b: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(b, lambda v: between(v, F.lit(low), F.lit(high)))


def area_xyxy(b: Column) -> Column:
    return (at(b, 2) - at(b, 0)) * (at(b, 3) - at(b, 1))


def area_xywh(b: Column) -> Column:
    return at(b, 2) * at(b, 3)


def area_xywha(b: Column) -> Column:
    return at(b, 2) * at(b, 3)


def clip_xyxy(b: Column, width: Column, height: Column) -> Column:
    return make(*(between(at(b, i), F.lit(0.0), (width if i % 2 == 0 else height).cast("double")) for i in range(4)))


def scale_xyxy(b: Column, sx: Column, sy: Column) -> Column:
    return make(*(at(b, i) * (sx if i % 2 == 0 else sy) for i in range(4)))


def center_xyxy(b: Column) -> Column:
    return make((at(b, 0) + at(b, 2)) / 2, (at(b, 1) + at(b, 3)) / 2)


def nonempty_xyxy(b: Column, threshold: float = 0.0) -> Column:
    return (at(b, 2) - at(b, 0) > threshold) & (at(b, 3) - at(b, 1) > threshold)


def inside_xyxy(b: Column, width: Column, height: Column, border: float = 0.0) -> Column:
    return (at(b, 0) >= -border) & (at(b, 1) >= -border) & (at(b, 2) < width + border) & (at(b, 3) < height + border)


def near_border(b: Column, margin: float = 0.025) -> Column:
    """Whether the centre of a relative xywh box is within ``margin`` of the image's border."""
    x, y = at(b, 0) + at(b, 2) / 2, at(b, 1) + at(b, 3) / 2
    return (x < margin) | (x > 1 - margin) | (y < margin) | (y > 1 - margin)


def is_zero(b: Column) -> Column:
    """No valid box: null, fewer than four numbers, or none of them positive."""
    return b.isNull() | (F.size(b) < 4) | F.forall(b, lambda v: F.coalesce(v <= 0, F.lit(True)))


def normal_angle(a: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def clip_xywha(b: Column, width: Column, height: Column, threshold: float = 1.0) -> Column:
    """Clip nearly upright boxes (angle within ``threshold`` degrees of 0); others stay as they are."""
    angle = normal_angle(at(b, 4))
    x0, y0, x1, y1 = (at(b, 0) - at(b, 2) / 2, at(b, 1) - at(b, 3) / 2, at(b, 0) + at(b, 2) / 2, at(b, 1) + at(b, 3) / 2)
    cx0, cx1 = (between(v, F.lit(0.0), width.cast("double")) for v in (x0, x1))
    cy0, cy1 = (between(v, F.lit(0.0), height.cast("double")) for v in (y0, y1))
    cut = make((cx0 + cx1) / 2, (cy0 + cy1) / 2, F.least(at(b, 2), cx1 - cx0), F.least(at(b, 3), cy1 - cy0), angle)
    same = make(at(b, 0), at(b, 1), at(b, 2), at(b, 3), angle)
    return F.when(F.abs(angle) <= threshold, cut).otherwise(same)


def scale_xywha(b: Column, sx: Column, sy: Column) -> Column:
    """Scale a rotated box: sides and angle follow the scaled axes."""
    t = F.radians(at(b, 4))
    c, s = F.cos(t), F.sin(t)
    w = at(b, 2) * F.sqrt((sx * c) * (sx * c) + (sy * s) * (sy * s))
    h = at(b, 3) * F.sqrt((sx * s) * (sx * s) + (sy * c) * (sy * c))
    return make(at(b, 0) * sx, at(b, 1) * sy, w, h, F.degrees(F.atan2(sx * s, sy * c)))


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def whole(*boxes: Column) -> Column:
    """Whether all boxes have four numbers."""
    parts = [at(b, i) for b in boxes for i in range(4)]
    return reduce(lambda p, q: p & q, (v.isNotNull() for v in parts))


def intersection_xyxy(a: Column, b: Column) -> Column:
    """Null if either box is null: greatest and least ignore nulls, so that is said here."""
    inter = _overlap(at(a, 0), at(a, 2), at(b, 0), at(b, 2)) * _overlap(at(a, 1), at(a, 3), at(b, 1), at(b, 3))
    return F.when(whole(a, b), inter)


def intersection_xywh(a: Column, b: Column) -> Column:
    x = _overlap(at(a, 0), at(a, 0) + at(a, 2), at(b, 0), at(b, 0) + at(b, 2))
    y = _overlap(at(a, 1), at(a, 1) + at(a, 3), at(b, 1), at(b, 1) + at(b, 3))
    return F.when(whole(a, b), x * y)


def union_xywh(a: Column, b: Column) -> Column:
    return area_xywh(a) + area_xywh(b) - intersection_xywh(a, b)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is not positive."""
    return F.when(whole > 0, part / whole).when(whole.isNotNull(), 0.0)


def iou_xywh(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for empty boxes."""
    return ratio_or_zero(intersection_xywh(a, b), union_xywh(a, b))


def iou_xyxy(a: Column, b: Column) -> Column:
    i = intersection_xyxy(a, b)
    return ratio_or_zero(i, area_xyxy(a) + area_xyxy(b) - i)


def giou_xyxy(a: Column, b: Column) -> Column:
    """Generalised: less the part of the hull that neither box covers."""
    i = intersection_xyxy(a, b)
    union = area_xyxy(a) + area_xyxy(b) - i
    hull = (F.greatest(at(a, 2), at(b, 2)) - F.least(at(a, 0), at(b, 0))) * (F.greatest(at(a, 3), at(b, 3)) - F.least(at(a, 1), at(b, 1)))
    return ratio_or_zero(i, union) - ratio_or_zero(hull - union, hull)


def ioa_xyxy(a: Column, b: Column, of: str = "second") -> Column:
    """Intersection over the area of the ``first`` or ``second`` box."""
    return ratio_or_zero(intersection_xyxy(a, b), area_xyxy(a if of == "first" else b))


def iom_xywh(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return ratio_or_zero(intersection_xywh(a, b), F.least(area_xywh(a), area_xywh(b)))


def edge_distances(x: Column, y: Column, b: Column) -> Column:
    """From a point to the left, top, right and bottom edge of an xyxy box."""
    return make(x - at(b, 0), y - at(b, 1), at(b, 2) - x, at(b, 3) - y)


def euclidean_similarity(a: Column, b: Column, zero_distance: float = 2.0) -> Column:
    """max(0, 1 - distance / zero_distance) of two vectors."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.greatest(F.lit(0.0), 1 - F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)) / zero_distance)


def keypoint_box(keypoints: Column) -> Column:
    """[x0, x1, y0, y1] ordered as x, y, w, h of [x, y, v, x, y, v, ...]."""
    xs = F.filter(keypoints, lambda v, i: i % 3 == 0)
    ys = F.filter(keypoints, lambda v, i: i % 3 == 1)
    return make(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def polygon_of_xywh(b: Column) -> Column:
    """Corners of a box as a flat polygon."""
    x0, y0, x1, y1 = at(b, 0), at(b, 1), at(b, 0) + at(b, 2), at(b, 1) + at(b, 3)
    return make(x0, y0, x0, y1, x1, y1, x1, y0)


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace formula over two arrays of coordinates."""
    turn = lambda v: F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1))
    cross = F.zip_with(F.zip_with(xs, turn(ys), lambda x, y: x * y), F.zip_with(ys, turn(xs), lambda y, x: y * x), lambda p, q: p - q)
    return F.when(F.size(xs) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def rounded(values: Column, digits: int = 5) -> Column:
    """Each number rounded half to even, as written in result files."""
    return F.transform(values, lambda v: F.bround(v, digits))


def crop_xyxy(b: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Moved into a crop and clipped to it."""
    moved = make(at(b, 0) - x, at(b, 1) - y, at(b, 2) - x, at(b, 3) - y)
    return make(*(between(at(moved, i), F.lit(0.0), (w if i % 2 == 0 else h).cast("double")) for i in range(4)))


def flip_xyxy(b: Column, width: Column) -> Column:
    """Mirrored left to right."""
    return make(width - at(b, 2), at(b, 1), width - at(b, 0), at(b, 3))


def pad_xyxy(b: Column, left: Column, top: Column) -> Column:
    return make(at(b, 0) + left, at(b, 1) + top, at(b, 2) + left, at(b, 3) + top)
