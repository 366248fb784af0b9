"""Run-length masks: codec, geometry and algebra over whole Arrow batches.

A mask is ``STRUCT<counts: STRING, size: ARRAY<INT>>``: column-major run lengths, background first, in the
compact text form (groups of 5 bits from ``0`` on, from the third run on as difference to the run before the
last). ``Runs`` holds the runs of all rows of a batch in flat arrays, so that decoding, areas, boxes and
overlaps are a few numpy calls a batch. Rows that are null, malformed, or whose runs don't add up to
height * width are invalid and give null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskloom.functions.kernel import kernel

MASK = "struct<counts: string, size: array<int>>"


def encode_counts(counts: Iterable[int]) -> str:
    out, c = [], [int(x) for x in counts]
    for i, x in enumerate(c):
        v = x - c[i - 2] if i > 2 else x
        while True:
            group, v = v & 0x1F, v >> 5
            more = v != (-1 if group & 0x10 else 0)
            out.append(chr((group | 0x20 if more else group) + 48))
            if not more:
                break
    return "".join(out)


class Runs:
    """Flat runs of many masks: ``counts[offsets[i]:offsets[i + 1]]`` are those of row i."""

    def __init__(self, counts: np.ndarray, offsets: np.ndarray, height: np.ndarray, width: np.ndarray, valid: np.ndarray):
        self.counts, self.offsets, self.height, self.width, self.valid = counts, offsets, height, width, valid
        n = np.diff(offsets)
        self.row = np.repeat(np.arange(len(n)), n)
        self.index = np.arange(len(counts)) - np.repeat(offsets[:-1], n)
        self.on = (self.index & 1).astype(np.int64)

    @classmethod
    def parse(cls, texts: list[str | None], sizes: list[list[int] | None]) -> Runs:
        known = np.array([t is not None and s is not None and len(s) == 2 and None not in s and min(s) >= 0 for t, s in zip(texts, sizes, strict=True)], bool)
        height = np.array([s[0] if k else 0 for s, k in zip(sizes, known, strict=True)], np.int64)
        width = np.array([s[1] if k else 0 for s, k in zip(sizes, known, strict=True)], np.int64)
        return cls._decoded(texts, height, width, known)

    @classmethod
    def of(cls, masks: pa.StructArray) -> Runs:
        """The same of an Arrow array, whose sizes needn't be Python's numbers."""
        texts, sizes = masks.flatten()
        at = sizes.offsets.to_numpy()[:-1].astype(np.int64)
        n = np.asarray(pc.fill_null(pc.list_value_length(sizes), 0))
        values = np.concatenate([np.asarray(pc.fill_null(sizes.values, -1)), [-1, -1]]).astype(np.int64)
        two = n == 2
        height, width = (np.where(two, values[np.where(two, at + k, 0)], -1) for k in (0, 1))
        known = (height >= 0) & (width >= 0) & np.asarray(texts.is_valid())
        return cls._decoded(texts.to_pylist(), np.where(known, height, 0), np.where(known, width, 0), known)

    @classmethod
    def _decoded(cls, texts: list[str | None], height: np.ndarray, width: np.ndarray, known: np.ndarray) -> Runs:
        raw = [t.encode("latin-1", "replace") if k else b"" for t, k in zip(texts, known.tolist(), strict=True)]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) - 48
        lengths = np.array([len(r) for r in raw], np.int64)
        row = np.repeat(np.arange(len(raw)), lengths)
        bad = np.zeros(len(raw), bool)
        np.logical_or.at(bad, row[(data < 0) | (data > 63)], True)
        last = (data & 0x20) == 0
        ends_row = np.cumsum(lengths)[lengths > 0] - 1
        np.logical_or.at(bad, row[ends_row[~last[ends_row]]], True)
        last[ends_row] = True  # so that a cut-off row doesn't run into the next
        ends = np.flatnonzero(last)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        shift = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
        np.logical_or.at(bad, row[shift > 8], True)
        shift = np.minimum(shift, 8)
        values = np.add.reduceat((data & 0x1F) << (5 * shift), starts) if len(starts) else np.zeros(0, np.int64)
        negative = (data[ends] & 0x10) != 0
        values -= np.where(negative, np.int64(1) << (5 * (shift[ends] + 1)), 0)
        own = row[ends]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(raw)))]).astype(np.int64)
        runs = cls(values, offsets, height, width, known & ~bad)
        return runs._undo_differences()._checked()

    def _undo_differences(self) -> Runs:
        """Runs 1, 3, 5, ... add up; so do runs 2, 4, 6, ...; run 0 stands alone."""
        for part in (1, 0):
            pick = np.flatnonzero((self.on == part) & (self.index > 0))
            if len(pick):
                total = np.cumsum(self.counts[pick])
                first = np.flatnonzero(np.concatenate([[True], self.row[pick][1:] != self.row[pick][:-1]]))
                before = np.repeat(total[first] - self.counts[pick][first], np.diff(np.concatenate([first, [len(pick)]])))
                self.counts[pick] = total - before
        return self

    def _checked(self) -> Runs:
        total = self.sums(self.counts)
        least = np.ones(len(self.valid), bool)
        np.logical_and.at(least, self.row, self.counts >= 0)
        self.valid &= least & (total == self.height * self.width)
        return self

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def areas(self) -> np.ndarray:
        return self.sums(self.counts * self.on)

    def blanked(self, valid: np.ndarray) -> Runs:
        """Rows that aren't ``valid`` as empty masks without size."""
        keep = np.repeat(valid, np.diff(self.offsets))
        n = np.where(valid, np.diff(self.offsets), 0)
        offsets = np.concatenate([[0], np.cumsum(n)])
        return Runs(self.counts[keep], offsets, np.where(valid, self.height, 0), np.where(valid, self.width, 0), valid)

    def boxes(self) -> np.ndarray:
        """x, y, w, h of each row's foreground; zeros for an empty mask."""
        own = self.blanked(self.valid)
        end = np.cumsum(own.counts)
        base = np.concatenate([[0], end])[own.offsets[:-1]]
        end = end - base[own.row]
        start = end - own.counts
        fg = (own.on == 1) & (own.counts > 0)
        r, s, e = own.row[fg], start[fg], end[fg] - 1
        h = own.height[r]
        x0, x1 = s // h, e // h
        one = x0 == x1
        y0, y1 = np.where(one, s % h, 0), np.where(one, e % h, h - 1)
        big = np.iinfo(np.int64).max
        low = [np.full(own.rows, big) for _ in range(2)]
        high = [np.full(own.rows, -1) for _ in range(2)]
        for to, v in ((low[0], x0), (low[1], y0)):
            np.minimum.at(to, r, v)
        for to, v in ((high[0], x1), (high[1], y1)):
            np.maximum.at(to, r, v)
        empty = high[0] < 0
        box = np.stack([low[0], low[1], high[0] - low[0] + 1, high[1] - low[1] + 1], 1)
        box[empty] = 0
        return box

    def intersections(self, other: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Common foreground of rows i of both, and whether both are valid and of one size. All rows lie on
        one axis, one after the other; the foreground of ``self`` up to a place is linear between its runs."""
        both = self.valid & other.valid & (self.height == other.height) & (self.width == other.width)
        a, b = self.blanked(both), other.blanked(both)
        at = np.concatenate([[0], np.cumsum(a.counts)])
        seen = np.concatenate([[0], np.cumsum(a.counts * a.on)])
        place = np.concatenate([[0], np.cumsum(b.counts)])
        common = np.diff(np.interp(place, at, seen)) if len(b.counts) else np.zeros(0)
        return b.sums(np.rint(common).astype(np.int64) * b.on), both


class Segments:
    """The foreground of many masks as vertical pieces of one column each, from ``top`` to before ``end``, in order of
    row, column and top; no two of a column touch. What is computed of them follows the pieces, not the pixels."""

    def __init__(self, runs: Runs):
        own = runs.blanked(runs.valid)
        self.height, self.width, self.rows = own.height, own.width, own.rows
        some = own.counts > 0
        row, on, n = own.row[some], own.on[some], own.counts[some]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (on[1:] != on[:-1])])) if len(row) else np.zeros(0, np.int64)
        row, on, n = row[first], on[first], np.add.reduceat(n, first) if len(first) else n  # runs that empty ones part are one
        stop = np.cumsum(n) - self._before(own.height * own.width)[row]
        row, start, stop = row[on == 1], (stop - n)[on == 1], stop[on == 1] - 1
        h = own.height[row]
        left = start // h
        pieces = stop // h - left + 1
        run, step = _spread(pieces)
        self.row, self.col, h = row[run], left[run] + step, h[run]
        self.top = np.where(step == 0, start[run] % h, 0)
        self.end = np.where(step == pieces[run] - 1, stop[run] % h + 1, h)

    @staticmethod
    def _before(sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(sizes)])[:-1]

    def _sums(self, row: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=values, minlength=self.rows).astype(np.int64)

    def _covered(self, parts: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Pixels of each row in any of the pieces (row, column, top, end), which may overlap."""
        row, col, top, end = (np.concatenate(p) for p in zip(*parts, strict=True))
        at = self._before(self.height * self.width)[row] + col * self.height[row]
        order = np.argsort(at + top, kind="stable")
        start, stop, row = (at + top)[order], (at + end)[order], row[order]
        reach = np.maximum.accumulate(stop)
        start[1:] = np.maximum(start[1:], reach[:-1])
        return self._sums(row, np.maximum(stop - start, 0))

    def _moved(self, by: int, top: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        col = self.col + by
        inside = (col >= 0) & (col < self.width[self.row])
        return self.row[inside], col[inside], top[inside], end[inside]

    def boundary_areas(self) -> np.ndarray:
        """Pixels that ``boundary`` has: squares of 2 x 2 with any foreground but not all. The last row and the last
        column stand for those after them."""
        top = np.maximum(self.top - 1, 0)
        some = self._covered([self._moved(0, top, self.end), self._moved(-1, top, self.end)])
        end = np.where(self.end == self.height[self.row], self.end, self.end - 1)
        last = self.col == self.width[self.row] - 1
        both = [self._moved(0, self.top, end), self._moved(-1, self.top, end), (self.row[last], self.col[last], self.top[last], end[last])]
        return some - (sum(self._sums(p[0], p[3] - p[2]) for p in both) - self._covered(both))

    def dilated_areas(self, size: int) -> np.ndarray:
        """Pixels that ``dilate`` has."""
        before = size // 2
        top = np.maximum(self.top + before - size + 1, 0)
        end = np.minimum(self.end + before, self.height[self.row])
        return self._covered([self._moved(k, top, end) for k in range(before - size + 1, before + 1)])

    def parts(self) -> np.ndarray:
        """Number of 8-connected parts: each piece hangs on the first that it touches in the column before, the
        other touching ones join their trees."""
        h = self.height[self.row] + 2
        at = self._before((self.height + 2) * (self.width + 2))[self.row] + (self.col + 1) * h
        start, stop = at + self.top, at + self.end
        low = np.searchsorted(stop, start - h, "left")
        n = np.maximum(np.searchsorted(start, stop - h, "right") - low, 0)
        own = np.arange(len(start))
        root = _roots(np.where(n > 0, low, own))
        a, step = _spread(np.maximum(n - 1, 0))
        b = low[a] + 1 + step
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            np.minimum.at(root, a, b)
            root = _roots(root)
        return self._sums(self.row[root == own], np.ones((root == own).sum()))

    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        """x, y of the pixel farthest from the background, the first one by row, and which rows have any."""
        out, some = np.zeros((self.rows, 2), np.int64), np.zeros(self.rows, bool)
        if not len(self.row):
            return out, some
        first = np.flatnonzero(np.concatenate([[True], self.row[1:] != self.row[:-1]]))
        n = np.diff(np.concatenate([first, [len(self.row)]]))
        row = self.row[first]
        some[row] = True
        x, y = self.col[first], np.minimum.reduceat(self.top, first)
        w, h = self.col[first + n - 1] - x + 1, np.maximum.reduceat(self.end, first) - y
        full = np.add.reduceat(self.end - self.top, first) == w * h  # rectangles
        out[row] = np.stack([x, y], 1) + ((np.minimum(w, h) + 1) // 2 - 1)[:, None]
        rest = np.flatnonzero(~full)
        rest = rest[np.lexsort((h[rest], w[rest]))]
        while len(rest):
            room = np.maximum.accumulate(h[rest]) * (np.maximum.accumulate(w[rest]) + 2) * np.arange(1, len(rest) + 1)
            k = max(1, int(np.searchsorted(room, CHUNK_PIXELS, "right")))
            now, rest = rest[:k], rest[k:]
            own, step = _spread(n[now])
            piece = first[now][own] + step
            far = _farthest(own, self.col[piece] - x[now][own], self.top[piece] - y[now][own], self.end[piece] - y[now][own], k, int(w[now].max()), int(h[now].max()))
            out[row[now]] = np.stack([x[now], y[now]], 1) + far
        return out, some


#: Pixels of the windows whose distances are computed at once.
CHUNK_PIXELS = 1 << 19


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index i ``n[i]`` times, and the place within its own."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def _farthest(own: np.ndarray, col: np.ndarray, top: np.ndarray, end: np.ndarray, n: int, w: int, h: int) -> np.ndarray:
    """x, y of the pixel of greatest ``distance`` in each of n windows of pieces: squared distances in the column, then
    the least over columns ever farther away. Windows have a column of background on both sides."""
    kind = np.int32 if h < 1 << 15 else np.int64
    g = np.zeros(n * (w + 2) * h, kind)
    piece, step = _spread(end - top)
    g[((own * (w + 2) + col + 1) * h + top)[piece] + step] = np.minimum(step + 1, (end - top)[piece] - step) ** 2
    g = g.reshape(n, w + 2, h)
    out, k = g.copy(), 1
    while k < w + 2 and k * k < out.max(initial=0):
        np.minimum(out[:, k:], g[:, :-k] + kind(k * k), out=out[:, k:])
        np.minimum(out[:, :-k], g[:, k:] + kind(k * k), out=out[:, :-k])
        k += 1
    best = out.transpose(0, 2, 1).reshape(n, -1).argmax(1)
    return np.stack([best % (w + 2) - 1, best // (w + 2)], 1)


def pixels(text: str, size: list[int]) -> np.ndarray:
    """The mask as height x width booleans."""
    r = Runs.parse([text], [size])
    return np.repeat(r.on.astype(bool), r.counts).reshape(size[1], size[0]).T


def from_pixels(mask: np.ndarray) -> tuple[str, list[int]]:
    flat = np.asarray(mask, bool).T.reshape(-1)
    edges = np.flatnonzero(np.diff(flat)) + 1
    places = np.concatenate([[0], edges, [len(flat)]])
    counts = np.diff(places).tolist()
    if len(flat) and flat[0]:
        counts = [0, *counts]
    return encode_counts(counts), [int(mask.shape[0]), int(mask.shape[1])]


def window(text: str, size: list[int], margin: int = 1) -> tuple[np.ndarray, int, int]:
    """The part of the mask around its foreground with ``margin`` pixels more, as far as the image has them,
    and its upper left corner (x, y): what the kernels below look at, instead of the whole image."""
    x, y, w, h = Runs.parse([text], [size]).boxes()[0]
    x0, y0 = max(0, int(x) - margin), max(0, int(y) - margin)
    return pixels(text, size)[y0 : int(y + h) + margin, x0 : int(x + w) + margin], x0, y0


def combine(masks: list[tuple[str, list[int]]], intersect: bool = False) -> tuple[str, list[int]] | None:
    """Union or intersection of masks of one size, by a sweep over their run ends."""
    if not masks:
        return None
    r = Runs.parse([m[0] for m in masks], [m[1] for m in masks])
    if not r.valid.all() or len({tuple(m[1]) for m in masks}) > 1:
        return None
    end = np.cumsum(r.counts)
    base = np.concatenate([[0], end])[r.offsets[:-1]]
    end = end - base[r.row]
    on = r.on == 1
    places = np.concatenate([end[on] - r.counts[on], end[on]])
    steps = np.concatenate([np.ones(on.sum(), np.int64), -np.ones(on.sum(), np.int64)])
    total = masks[0][1][0] * masks[0][1][1]
    spots, inverse = np.unique(np.concatenate([[0], places, [total]]), return_inverse=True)
    change = np.bincount(inverse[1:-1], weights=steps, minlength=len(spots)).astype(np.int64)
    depth = np.cumsum(change)[:-1]
    inside = depth >= (len(masks) if intersect else 1)
    length = np.diff(spots)
    turn = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]])) if len(inside) else np.zeros(0, int)
    counts = np.add.reduceat(length, turn).tolist() if len(turn) else []
    if len(inside) and inside[0]:
        counts = [0, *counts]
    return encode_counts(counts), list(masks[0][1])


def boundary(mask: np.ndarray) -> np.ndarray:
    """Pixels that differ from their right, lower or lower right neighbour; one pixel wide."""
    e, s, se = mask.copy(), mask.copy(), mask.copy()
    e[:, :-1], s[:-1], se[:-1, :-1] = mask[:, 1:], mask[1:], mask[1:, 1:]
    out = (mask ^ e) | (mask ^ s) | (mask ^ se)
    out[-1], out[:, -1] = (mask[-1] ^ e[-1]), (mask[:, -1] ^ s[:, -1])
    if out.size:
        out[-1, -1] = False
    return out


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    """By a square of ``size`` pixels: a running maximum along rows, then columns."""
    before = size // 2
    for axis in (0, 1):
        total = np.cumsum(np.insert(mask.astype(np.int64), 0, 0, axis), axis)
        n = mask.shape[axis]
        low = np.clip(np.arange(n) - before, 0, n)
        high = np.clip(np.arange(n) - before + size, 0, n)
        mask = (np.take(total, high, axis) - np.take(total, low, axis)) > 0
    return mask


def boundary_f(pred: np.ndarray, truth: np.ndarray, size: tuple[int, int] | None = None, ratio: float = 0.008) -> float:
    """F measure of the boundaries within a tolerance of ``ratio`` of the image's diagonal (1 if both are empty)."""
    reach = max(1, int(np.ceil(ratio * np.hypot(*(size or pred.shape)))))
    p, t = boundary(pred), boundary(truth)
    if not p.any() and not t.any():
        return 1.0
    if not p.any() or not t.any():
        return 0.0
    precision = (p & dilate(t, 2 * reach + 1)).sum() / p.sum()
    recall = (t & dilate(p, 2 * reach + 1)).sum() / t.sum()
    return float(2 * precision * recall / (precision + recall)) if precision + recall else 0.0


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels from 1 on of the 8-connected parts (0 is background), and each pixel's part size. Union-find over
    the vertical runs, so the work follows the runs rather than the pixels."""
    h, w = mask.shape
    padded = np.zeros((w, h + 2), np.int8)
    padded[:, 1:-1] = mask.T
    edge = np.diff(padded, axis=1)
    column, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    parent = np.arange(len(start))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(column, np.arange(w + 1))
    for c in range(1, w):
        i, j = first[c - 1], first[c]
        while i < first[c] and j < first[c + 1]:
            if start[i] <= stop[j] and start[j] <= stop[i]:  # runs that touch, also at a corner
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(start))], np.int64)
    names, label = np.unique(roots, return_inverse=True)
    sizes = np.bincount(label, weights=stop - start, minlength=len(names)).astype(np.int64)
    labels, area = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    for c, s, e, k in zip(column, start, stop, label, strict=True):
        labels[s:e, c], area[s:e, c] = k + 1, sizes[k]
    return labels, area


def fill_holes(mask: np.ndarray, most: int) -> np.ndarray:
    """Background parts of at most ``most`` pixels become foreground."""
    _, area = components(~mask)
    return mask | ((area > 0) & (area <= most))


def drop_sprinkles(mask: np.ndarray, most: int) -> np.ndarray:
    """Foreground parts of at most ``most`` pixels, but never more than half of the mask, go."""
    _, area = components(mask)
    return mask & ~((area > 0) & (area <= min(most, int(mask.sum()) // 2)))


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each foreground pixel to the background: squared distances down the columns, then
    the least over columns ever farther away, which ends at the greatest distance there is."""
    h, w = mask.shape
    far = float(h * h + w * w + 1)
    g = np.where(mask, far, 0.0)
    for k in range(1, h):
        g[k] = np.where(mask[k], np.minimum(g[k], (np.sqrt(g[k - 1]) + 1) ** 2), 0)
    for k in range(h - 2, -1, -1):
        g[k] = np.where(mask[k], np.minimum(g[k], (np.sqrt(g[k + 1]) + 1) ** 2), 0)
    out, step = g.copy(), 1
    while step < w and step * step < out.max(initial=0):
        np.minimum(out[:, step:], g[:, :-step] + step * step, out=out[:, step:])
        np.minimum(out[:, :-step], g[:, step:] + step * step, out=out[:, :-step])
        step += 1
    return np.sqrt(np.minimum(out, far))


def polygon_mask(polygons: list[list[float]], size: list[int]) -> np.ndarray:
    """Pixels whose centre is inside any polygon (even-odd rule), by scan lines."""
    h, w = size
    out = np.zeros((h, w), bool)
    x_centre = np.arange(w) + 0.5
    for flat in polygons:
        p = np.asarray(flat, float).reshape(-1, 2)
        q = np.roll(p, -1, 0)
        for y in range(max(0, int(p[:, 1].min())), min(h, int(np.ceil(p[:, 1].max())))):
            yc = y + 0.5
            cross = (p[:, 1] <= yc) != (q[:, 1] <= yc)
            if cross.any():
                a, b = p[cross], q[cross]
                xs = np.sort(a[:, 0] + (yc - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
                out[y] |= (np.searchsorted(xs, x_centre, side="left") % 2) == 1
    return out


# Column expressions


def _parsed(masks: pa.Array) -> Runs:
    masks = masks.combine_chunks() if isinstance(masks, pa.ChunkedArray) else masks
    return Runs.of(masks)


def _masked(values: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=~valid)


@kernel("bigint")
def mask_area(masks: pa.Array) -> pa.Array:
    r = _parsed(masks)
    return _masked(r.areas(), r.valid, pa.int64())


@kernel("array<double>")
def mask_box(masks: pa.Array) -> pa.Array:
    """x, y, w, h; zeros for an empty mask, null for none."""
    r = _parsed(masks)
    return pa.array([b if v else None for b, v in zip(r.boxes().astype(float).tolist(), r.valid, strict=True)], pa.list_(pa.float64()))


@kernel("array<int>")
def mask_counts(masks: pa.Array) -> pa.Array:
    """The run lengths."""
    r = _parsed(masks)
    return pa.array([r.counts[a:b].tolist() if v else None for a, b, v in zip(r.offsets[:-1], r.offsets[1:], r.valid, strict=True)], pa.list_(pa.int32()))


@kernel("string")
def counts_text(counts: pa.Array) -> pa.Array:
    """Run lengths in the compact text form."""
    return pa.array([None if c is None or None in c else encode_counts(c) for c in counts.to_pylist()], pa.string())


@kernel("bigint")
def mask_intersection(a: pa.Array, b: pa.Array) -> pa.Array:
    common, both = _parsed(a).intersections(_parsed(b))
    return _masked(common, both, pa.int64())


@kernel("double")
def mask_iou(a: pa.Array, b: pa.Array) -> pa.Array:
    """Intersection over union; 0 if both are empty."""
    x, y = _parsed(a), _parsed(b)
    common, both = x.intersections(y)
    return _masked(common / np.maximum(x.areas() + y.areas() - common, 1), both, pa.float64())


@kernel("double")
def mask_iom(a: pa.Array, b: pa.Array) -> pa.Array:
    """Intersection over the smaller area; 0 if that is empty."""
    x, y = _parsed(a), _parsed(b)
    common, both = x.intersections(y)
    return _masked(common / (np.maximum(np.minimum(x.areas(), y.areas()), 1) + 1e-8), both, pa.float64())


def _together(p: dict, q: dict) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Both masks in the window that holds them, and the image's size."""
    boxes = Runs.parse([p["counts"], q["counts"]], [p["size"], q["size"]]).boxes()
    boxes = boxes[boxes[:, 2] > 0]
    if not len(boxes):
        return np.zeros((1, 1), bool), np.zeros((1, 1), bool), tuple(p["size"])
    x0, y0 = (max(0, int(v) - 1) for v in boxes[:, :2].min(0))
    x1, y1 = (int(v) + 1 for v in (boxes[:, :2] + boxes[:, 2:]).max(0))
    return pixels(p["counts"], p["size"])[y0:y1, x0:x1], pixels(q["counts"], q["size"])[y0:y1, x0:x1], tuple(p["size"])


def _pairs(one: Callable[[np.ndarray, np.ndarray, tuple[int, int]], float]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(a.to_pylist(), b.to_pylist(), strict=True):
            ok = p is not None and q is not None and p["size"] == q["size"] and Runs.parse([p["counts"], q["counts"]], [p["size"], q["size"]]).valid.all()
            out.append(one(*_together(p, q)) if ok else None)
        return pa.array(out, pa.float64())

    return run


def mask_boundary_f(a: Column, b: Column) -> Column:
    """F measure of two masks' boundaries."""
    return F.arrow_udf(_pairs(boundary_f), "double")(a, b)


def _each(one: Callable[[np.ndarray], np.ndarray], margin: int = 1) -> Callable[[pa.Array], pa.Array]:
    """``one`` over the window of each mask; it may change ``margin`` pixels around the foreground."""

    def run(masks: pa.Array) -> pa.Array:
        out = []
        for m in masks.to_pylist():
            if m is None or not Runs.parse([m["counts"]], [m["size"]]).valid[0]:
                out.append(None)
            else:
                part, x, y = window(m["counts"], m["size"], margin)
                whole = np.zeros(m["size"], bool)
                whole[y : y + part.shape[0], x : x + part.shape[1]] = one(part)
                text, size = from_pixels(whole)
                out.append({"counts": text, "size": size})
        return pa.array(out, pa.struct([("counts", pa.string()), ("size", pa.list_(pa.int32()))]))

    return run


def mask_boundary(mask: Column) -> Column:
    return F.arrow_udf(_each(boundary), MASK)(mask)


def mask_dilated(mask: Column, size: int = 3) -> Column:
    return F.arrow_udf(_each(lambda m: dilate(m, size), size), MASK)(mask)


def mask_holes_filled(mask: Column, most: int) -> Column:
    return F.arrow_udf(_each(lambda m: fill_holes(m, most)), MASK)(mask)


def mask_sprinkles_dropped(mask: Column, most: int) -> Column:
    return F.arrow_udf(_each(lambda m: drop_sprinkles(m, most)), MASK)(mask)


@kernel("int")
def mask_components(masks: pa.Array) -> pa.Array:
    """Number of 8-connected parts."""
    r = _parsed(masks)
    return _masked(Segments(r).parts(), r.valid, pa.int32())


def _points(segments: Segments) -> pa.Array:
    at, some = segments.centres()
    return pa.array([p if k else None for p, k in zip(at.tolist(), some, strict=True)], pa.list_(pa.int32()))


@kernel("array<int>")
def mask_centre(masks: pa.Array) -> pa.Array:
    """x, y of the pixel farthest from the background (the first one by row); null for an empty mask."""
    return _points(Segments(_parsed(masks)))


def mask_morphology(mask: Column, size: int = 3) -> Column:
    """Areas of the boundary and of the mask dilated by ``size``, parts and centre, of a mask that is decoded once; nulls for none."""

    @F.arrow_udf("struct<boundary: bigint, dilated: bigint, parts: int, centre: array<int>>")
    def run(masks: pa.Array) -> pa.Array:
        r = _parsed(masks)
        s = Segments(r)
        values = [_masked(s.boundary_areas(), r.valid, pa.int64()), _masked(s.dilated_areas(size), r.valid, pa.int64()), _masked(s.parts(), r.valid, pa.int32()), _points(s)]
        return pa.StructArray.from_arrays(values, ["boundary", "dilated", "parts", "centre"])

    return run(mask)


def mask_of_polygons(polygons: Column, size: Column) -> Column:
    """The mask of ARRAY<ARRAY<DOUBLE>> polygons in an image of ``size`` [height, width]."""

    @F.arrow_udf(MASK)
    def run(p: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for flat, hw in zip(p.to_pylist(), s.to_pylist(), strict=True):
            if flat is None or hw is None:
                out.append(None)
            else:
                text, size = from_pixels(polygon_mask([f for f in flat if f is not None and len(f) >= 6], hw))
                out.append({"counts": text, "size": size})
        return pa.array(out, pa.struct([("counts", pa.string()), ("size", pa.list_(pa.int32()))]))

    return run(polygons, size)


def union_masks(masks: Column) -> Column:
    """The union of ARRAY<mask> (nulls left out); null if there is none, or if their sizes differ."""

    @F.arrow_udf(MASK)
    def run(lists: pa.Array) -> pa.Array:
        out = []
        for own in lists.to_pylist():
            merged = combine([(m["counts"], m["size"]) for m in own or [] if m is not None])
            out.append(None if merged is None else {"counts": merged[0], "size": merged[1]})
        return pa.array(out, pa.struct([("counts", pa.string()), ("size", pa.list_(pa.int32()))]))

    return run(masks)


def non_overlapping(masks: list[np.ndarray], scores: list[float]) -> list[np.ndarray]:
    """Each pixel stays with the best-scoring mask that has it; equal scores: the first."""
    order = sorted(range(len(masks)), key=lambda i: (-scores[i], i))
    taken, out = None, list(masks)
    for i in order:
        out[i] = masks[i] if taken is None else masks[i] & ~taken
        taken = masks[i] if taken is None else taken | masks[i]
    return out
