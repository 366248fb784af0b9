"""Text, path and colour expressions."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.kernel import kernel

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_lower(text: Column) -> Column:
    return F.lower(squeeze(text))


@kernel("string")
def unescape_twice(values: pa.Array) -> pa.Array:
    """HTML entities resolved twice, then trimmed."""
    return pa.array([None if v is None else html.unescape(html.unescape(v)).strip() for v in values.to_pylist()], pa.string())


def canonical(text: Column, keep: str | None = None) -> Column:
    """Underscores as blanks, no punctuation (but for the exact substring ``keep``), lower case, squeezed."""
    blank = F.translate(text, "_", " ")
    bare = lambda t: F.translate(t, PUNCTUATION, "")
    if keep:
        pattern = "".join("\\" + c if not c.isalnum() else c for c in keep)
        blank = F.array_join(F.transform(F.split(blank, pattern, -1), bare), keep)
    else:
        blank = bare(blank)
    return F.trim(F.regexp_replace(F.lower(blank), r"\s+", " "))


def with_affixes(text: Column, prefix: str = "", suffix: str = "", only: list[str] | None = None) -> Column:
    """Prefix and suffix, on texts of the list ``only`` (case and outer blanks don't matter) or on all."""
    changed = F.concat(F.lit(prefix), text, F.lit(suffix))
    return changed if only is None else F.when(F.lower(F.trim(text)).isin([t.strip().lower() for t in only]), changed).otherwise(text)


def path_parts(path: Column, sep: str = "/") -> Column:
    return F.split(path, "\\" + sep)


def frame_address(path: Column) -> Column:
    """``file@N`` as (file, frame); a path without frame has null."""
    return F.struct(F.split_part(path, F.lit("@"), F.lit(1)).alias("file"), F.try_to_number(F.nullif(F.split_part(path, F.lit("@"), F.lit(2)), F.lit("")), F.lit("9999999999")).cast("int").alias("frame"))


def join_but_last(text: Column, sep: str, last: int) -> Column:
    """Everything but the last ``last`` parts."""
    parts = F.split(text, sep)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - last, F.lit(0))), sep)


def sized_url(base: Column, key: Column, pixels: Column, limit: int) -> Column:
    """URL of the full file, or of a scaled one if it has more pixels than ``limit``; unknown is full."""
    full = F.concat(base, F.lit("/"), key, F.lit("/full/full/0/default.jpg"))
    scaled = F.concat(base, F.lit("/"), key, F.lit("/full/!"), F.lit(str(limit)), F.lit(","), F.lit(str(limit)), F.lit("/0/default.jpg"))
    return F.when(pixels.isNull() | F.isnan(pixels.cast("double")) | (pixels <= limit), full).otherwise(scaled)


def mapped_or_error(value: Column, mapping: dict[str, str]) -> Column:
    """The mapped value; an unknown one raises."""
    out = None
    for k, v in mapping.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("not mapped: "), value)))


def thresholded_name(name: Column, threshold: Column) -> Column:
    return F.concat(name, F.lit("@"), threshold.cast("string"))


def hex_to_rgb(text: Column) -> Column:
    digits = F.replace(text, F.lit("#"), F.lit(""))
    return F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(c)), 2, "0") for c in (r, g, b)))


def palette_index(i: Column, n: int) -> Column:
    return F.pmod(i, F.lit(n))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def presence_score(logit: Column, presence: Column) -> Column:
    return sigmoid(logit) * sigmoid(presence)


def sine_encoding(position: Column, dim: int, temperature: float = 10_000.0) -> Column:
    """``dim // 2`` sines, then as many cosines, of a position."""
    half = dim // 2
    angles = [position / temperature ** (2 * (i // 2) / half) for i in range(half)]
    return F.array(*(F.sin(a) for a in angles), *(F.cos(a) for a in angles))


def heatmap_cell(x: Column, y: Column, box: Column, size: int) -> Column:
    """The cell (column, row) of a keypoint in a ``size`` x ``size`` grid over an xyxy box; the far edge is in
    the last cell; null outside the box."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    cell = lambda v, a, b: F.when(v == b, size - 1).otherwise(F.floor((v - a) * F.try_divide(F.lit(float(size)), b - a)).cast("int"))
    cx, cy = cell(x, x0, x1), cell(y, y0, y1)
    return F.when((cx >= 0) & (cy >= 0) & (cx < size) & (cy < size), F.struct(cx.alias("column"), cy.alias("row")))


def focal_loss(logit: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Sigmoid focal loss of one value."""
    p = sigmoid(logit)
    entropy = F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
    hit = p * target + (1 - p) * (1 - target)
    return (alpha * target + (1 - alpha) * (1 - target)) * entropy * F.pow(1 - hit, F.lit(gamma))


def dice_loss(products: Column, left: Column, right: Column) -> Column:
    """From the sums of x*y, x and y."""
    return 1 - (2 * products + 1) / (left + right + 1)
