"""Pieces of oversized texts, cut at natural boundaries, by byte ranges.

A text of more than ``RANGE_BYTES``, or a file, is handled as byte ranges. Near each range end, a worker looks in a
halo for the best place where the ranges may part: one where the tokenizer surely begins anew, so tokens of the
ranges are the tokens of the text. An end without such a place is dropped, its ranges stay together.

Where a piece ends depends on where it begins and on the boundaries of the next tokens only, so the cuts of a text
are a walk by jumps from token 0 on. Ranges are tokenized apart; each has the boundary levels of its own tokens and
of the first ones after it. From these it makes a table: to every place among its first tokens at which the walk may
enter, the place at which it leaves, and the pieces in between. The tables of a text are stitched in order, prefix
sums of the tokens and bytes give the places in the text, and each range emits the pieces of its own part of the
walk, by offset. So pieces are the same for any size of the ranges, and no worker has more of a text than a range
and its halo. A text within one range takes the same jumps, without the tables.

Texts of at most as many bytes as a piece may have tokens can't be oversized (a token has a byte at least)
and are never tokenized.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.llm.tokens import readable, tokenizer, vocabulary_path
from maskloom.operators.grouped import spread
from maskloom.shared import materialize

MOST, SHARED = 512, 32
RANGE_BYTES = 1 << 18
HALO = 1 << 12
NAMES = ("inside", "word", "sentence", "line", "paragraph", "end")  #: kinds of cut, by level; the last is the text's end
END = len(NAMES) - 1
LEVEL, ALIGNED = 7, 8  #: bits of a token's mark: level of the boundary before it, and whether it begins a character
CONTEXT = 8  #: characters before a range that may decide the level of its begin

STOPS, CLOSERS = ".!?…؟。！？", "'\"”’»)]」』）"
WIDE_STOPS, WIDE_CLOSERS, WIDE_PAUSES = "。！？；…", "”’」』）", "，、："


def _table(characters: str) -> np.ndarray:
    """Membership by code point, for those below 2 ** 16."""
    out = np.zeros(1 << 16, bool)
    out[[ord(c) for c in characters]] = True
    return out


_SPACE = _table("".join(c for c in map(chr, range(1 << 16)) if c.isspace()))
_IN = {name: _table(own) for name, own in (("stop", STOPS), ("closer", CLOSERS), ("wide", WIDE_STOPS), ("wide_closer", WIDE_CLOSERS), ("pause", WIDE_PAUSES))}


def _after(codes: np.ndarray, places: np.ndarray, ends: np.ndarray, closers: np.ndarray) -> np.ndarray:
    """Whether the characters before each place are one of ``ends`` and at most three ``closers``."""
    found, open_ = np.zeros(len(places), bool), np.ones(len(places), bool)
    for back in range(1, 5):
        at = places - back
        open_ &= at >= 0
        c = codes[np.maximum(at, 0)]
        found |= open_ & ends[c]
        open_ &= closers[c]
    return found


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets where ``text`` may be cut naturally, ascending, and their levels. All are places between two
    tokens: before white space that follows something else, or between a wide stop and a letter or digit. A level
    depends on the four characters before, and on the white space or character after."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0xFFFF).astype(np.int64)
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[codes]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin = edge[space[edge]]  # of white space that follows something else
    stop = edge[~space[edge]]
    stop = stop[1:] if space[0] else stop
    begin = begin[: len(stop)]  # white space at the end of the text is no boundary
    lines = np.concatenate([[0], np.cumsum(codes == 10)])
    lines = lines[stop] - lines[begin]
    level = np.where(lines > 1, 4, np.where(lines == 1, 3, np.where(_after(codes, begin, _IN["stop"], _IN["closer"]), 2, 1)))
    before = codes[:-1]
    wide = np.flatnonzero((_IN["wide"][before] | _IN["wide_closer"][before] | _IN["pause"][before]) & ~space[1:]) + 1
    if len(wide):
        word = np.array([text[i].isalnum() or text[i] == "_" for i in wide.tolist()], bool)
        full = _after(codes, wide, _IN["wide"], _IN["wide_closer"])
        wide_level = np.where(full, 2, np.where(_IN["pause"][codes[wide - 1]], 1, 0)) * word
        wide, wide_level = wide[wide_level > 0], wide_level[wide_level > 0]
        begin, level = np.concatenate([begin, wide]), np.concatenate([level, wide_level])
        order = np.argsort(begin, kind="stable")
        begin, level = begin[order], level[order]
    return begin, level


def byte_offsets(text: str) -> np.ndarray:
    """The byte at which each character begins, and the length."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    return np.concatenate([[0], np.cumsum(width)])


def whole_characters(data: bytes) -> tuple[int, int]:
    """Begin and end of ``data`` without the characters that are cut off at either end."""
    begin = next((i for i in range(min(4, len(data))) if data[i] & 0xC0 != 0x80), 0)
    for back in range(1, min(4, len(data)) + 1):
        if data[-back] & 0xC0 != 0x80:
            need = 1 + (data[-back] >= 0xC0) + (data[-back] >= 0xE0) + (data[-back] >= 0xF0)
            return begin, len(data) - back if need > back else len(data)
    return begin, len(data)


def parting(window: bytes) -> int | None:
    """The byte of the best boundary in the halo (the first of the highest level), None if there is none, or if
    ``window`` has bytes that are no text. It may begin and end inside a character."""
    begin, end = whole_characters(window)
    try:
        text = window[begin:end].decode("utf-8")
    except UnicodeDecodeError:
        return None
    places, level = boundaries(text)
    if not len(places):
        return None
    return begin + len(text[: int(places[np.argmax(level)])].encode())


def marks_of(before: str, text: str, ids: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and mark of each token of ``text``, which follows ``before``."""
    data = np.frombuffer(text.encode(), np.uint8)
    widths = lengths[np.asarray(ids, np.int64)]
    starts = np.cumsum(widths) - widths
    places, level = boundaries(before + text)
    places = places - len(before)
    own = places >= 0
    levels = np.zeros(len(data) + 1, np.uint8)
    levels[byte_offsets(text)[places[own]]] = level[own]
    return widths, levels[starts] | np.where((data[starts] & 0xC0) != 0x80, ALIGNED, 0).astype(np.uint8)


def jumps(marks: np.ndarray, n: int, before: int, total: int, most: int, shared: int) -> np.ndarray:
    """The end of the piece that adds tokens from each of the first ``n`` tokens on. ``marks`` are those of these tokens
    and of the next ``most``, as far as the text of ``total`` tokens has them; ``before`` tokens precede. The piece
    begins ``shared`` tokens earlier. Its end is the last boundary of the highest level in the later half of what may
    be added, else in the first half, else between characters."""
    e = np.arange(n)
    limit = np.maximum(e + before - shared, 0) - before + most
    final = limit + before >= total
    within = np.minimum(limit, len(marks) - 1)
    low = np.minimum(e + np.maximum(1, (limit - e) // 2), within + 1)
    level, place = marks & LEVEL, np.arange(len(marks))
    last = {k: np.maximum.accumulate(np.where(level == k, place, -1)) for k in range(1, END)}
    end = np.full(n, -1)
    for at, least in ((within, low), (low - 1, e + 1)):
        for k in range(END - 1, 0, -1):
            found = last[k][at]
            end = np.where((end < 0) & (found >= least), found, end)
    aligned = np.maximum.accumulate(np.where(marks & ALIGNED, place, -1))[within]
    end = np.where(end < 0, np.where(aligned > e, aligned, limit), end)
    return np.where(final, total - before, end)


def cuts(marks: np.ndarray, most: int, shared: int) -> list[tuple[int, int, int]]:
    """(first token, last + 1, kind of cut) of the pieces of a whole text."""
    n = len(marks)
    to, out, at = jumps(marks, n, 0, n, most, shared), [], 0
    while at < n:
        end = int(to[at])
        out.append((max(0, at - shared), end, END if end == n else int(marks[end] & LEVEL)))
        at = end
    return out


PIECE = pa.schema([("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("cut", pa.string()), ("text", pa.string())])
PIECES = "doc_id BIGINT, piece_no INT, start_token BIGINT, n_tokens INT, start_byte BIGINT, end_byte BIGINT, cut STRING, text STRING"


class Emitter:
    """Rows of ``PIECE``; hands out batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, doc: int, k: int, start: int, n: int, data: bytes, at: int, base: int, end: int, level: int) -> None:
        """``data[at:end]`` is the piece, ``base`` the text's byte at which data begins."""
        whole = at
        while whole > 0 and data[whole] & 0xC0 == 0x80:  # begins inside a character
            whole -= 1
        self.rows.append((doc, k, start, n, base + at, base + end, NAMES[level], data[whole:end].decode("utf-8", "replace")))
        self.size += end - whole

    def take(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.size >= least and self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), PIECE, strict=True)], schema=PIECE)
            self.rows, self.size = [], 0


BATCH_BYTES = 1 << 23  #: bytes of pieces sent together


def _short(docs: DataFrame, most: int, shared: int, at: str) -> DataFrame:
    """Pieces of texts that are one range: doc_id, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = tokenizer(at), Emitter()
        for b in batches:
            texts = readable(b.column(1))
            for doc, text, ids in zip(b.column(0).to_pylist(), texts, own.encode(texts), strict=True):
                if len(ids) <= most:
                    continue
                widths, marks = marks_of("", text, ids, own.lengths)
                ends, data = np.concatenate([[0], np.cumsum(widths)]), text.encode()
                for k, (start, end, level) in enumerate(cuts(marks, most, shared)):
                    out.add(doc, k, start, end - start, data, int(ends[start]), 0, int(ends[end]), level)
                yield from out.take(BATCH_BYTES)
        yield from out.take()

    return docs.mapInArrow(run, PIECES)


RANGE = "doc_id BIGINT, range_no INT, lead INT, size INT, data BINARY"


def text_ranges(docs: DataFrame, range_bytes: int, back: int, ahead: int) -> DataFrame:
    """The ranges of texts doc_id, bytes: ``RANGE``; ``data`` has ``lead`` bytes before the ``size`` own ones, and some after."""

    @F.arrow_udf("array<int>")
    def find(windows: pa.Array) -> pa.Array:
        return pa.array([[parting(w) for w in row] for row in windows.to_pylist()], pa.list_(pa.int32()))

    long = docs.withColumn("at", F.sequence(F.lit(range_bytes), F.octet_length("bytes") - 1, F.lit(range_bytes)))
    halo = min(HALO, range_bytes // 2)
    window = F.transform("at", lambda x: F.substring(F.col("bytes"), x + 1, F.lit(halo)))
    inner = F.filter(F.zip_with("at", find(window), lambda x, f: x + f), lambda e: e.isNotNull())
    ends = F.concat(F.array(F.lit(0)), inner, F.array(F.octet_length("bytes")))
    spans = long.select("doc_id", "bytes", ends.alias("ends")).select("doc_id", "bytes", "ends", F.posexplode(F.slice("ends", F.lit(1), F.size("ends") - 1)).alias("range_no", "begin"))
    begin, end = F.col("begin"), F.col("ends")[F.col("range_no") + 1]
    lead = F.least(begin, F.lit(back))
    data = F.substring("bytes", begin - lead + 1, end - begin + lead + F.lit(ahead))
    ranges = spans.select("doc_id", "range_no", lead.alias("lead"), (end - begin).alias("size"), data.alias("data"))
    return spread(ranges, ["doc_id", "range_no"])  # a giant text's ranges are spread over the tasks


def _opened(path: str):  # noqa: ANN202
    """(file system, path there) of a local path or a URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def file_ranges(files: DataFrame, range_bytes: int, back: int, ahead: int) -> DataFrame:
    """The ranges of UTF-8 files doc_id, path: ``RANGE``. Files are read by ranges: first the halos at the range ends, then
    each range by its own task."""
    halo = min(HALO, range_bytes // 2)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, own = _opened(path)
                size = system.get_file_info(own).size or 0
                at = np.arange(0, max(size, 1), range_bytes)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([path] * n, pa.string()), pa.array([size] * n, pa.int64()), pa.array(at, pa.int64())], names=["doc_id", "path", "size", "at"])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, at in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if at:
                    system, own = _opened(path)
                    with system.open_input_file(own) as f:
                        place = parting(f.read_at(halo, at))
                    at = None if place is None else at + place
                found.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.int64())], names=b.schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, no, path, begin, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, own = _opened(path)
                lead = min(begin, back)
                with system.open_input_file(own) as f:
                    data = f.read_at(end - begin + lead + ahead, begin - lead)
                # bytes that are no text become U+FFFD here, as they do in a column of texts
                parts = [p.decode("utf-8", "replace").encode() for p in (data[:lead], data[lead : lead + end - begin], data[lead + end - begin :])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([no], pa.int32()), pa.array([len(parts[0])], pa.int32()), pa.array([len(parts[1])], pa.int32()), pa.array([b"".join(parts)], pa.binary())],
                    names=["doc_id", "range_no", "lead", "size", "data"],
                )

    ends = spread(files.select(F.col("doc_id").cast("long"), F.col("path").cast("string")), ["doc_id"]).mapInArrow(sized, "doc_id BIGINT, path STRING, size BIGINT, at BIGINT")
    ends = spread(ends, ["doc_id", "at"]).mapInArrow(parted, "doc_id BIGINT, path STRING, size BIGINT, at BIGINT").where("at IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("at")  # a few numbers a range
    spans = ends.select("doc_id", (F.row_number().over(order) - 1).alias("range_no"), "path", F.col("at").alias("begin"), F.coalesce(F.lead("at").over(order), "size").alias("end"))
    return spread(spans, ["doc_id", "range_no"]).mapInArrow(read, RANGE)


TOKENIZED = f"{RANGE}, widths BINARY, marks BINARY"
STEP = np.dtype([("leaves", "<i4"), ("pieces", "<i4")])


def _tokenized(ranges: DataFrame, at: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(at)
        for b in batches:
            widths, marks = [], []
            lead, size, data = (b.column(i).to_pylist() for i in (2, 3, 4))
            texts = [d[s : s + n].decode("utf-8", "replace") for d, s, n in zip(data, lead, size, strict=True)]
            for d, s, text, ids in zip(data, lead, texts, own.encode(texts), strict=True):
                context = d[max(0, s - 4 * CONTEXT) : s]
                w, m = marks_of(context[whole_characters(context)[0] :].decode("utf-8", "replace"), text, ids, own.lengths)
                widths.append(w.astype("<u2").tobytes())
                marks.append(m.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(widths, pa.binary()), pa.array(marks, pa.binary())], names=[*b.schema.names, "widths", "marks"])

    return ranges.mapInArrow(run, TOKENIZED)


def _around(r: dict, most: int, shared: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Widths of the tokens around and in a range, marks from its first token on, tokens before and of its own."""
    tail = np.frombuffer(b"".join(r["tails"]), "<u2")[-shared:] if shared else np.zeros(0, "<u2")
    heads = [np.frombuffer(b"".join(r[c]), t)[:most] for c, t in (("head_widths", "<u2"), ("head_marks", np.uint8))]
    own, marks = np.frombuffer(r["widths"], "<u2"), np.frombuffer(r["marks"], np.uint8)
    return np.concatenate([tail, own, heads[0]]).astype(np.int64), np.concatenate([marks, heads[1]]), len(tail), len(own)


def _long(ranges: DataFrame, most: int, shared: int, range_bytes: int, at: str) -> DataFrame:
    """Pieces of texts in ranges, by stitched tables."""
    keys = ["doc_id", "range_no"]
    tokens = materialize(_tokenized(ranges, at), "ranges")
    line = Window.partitionBy("doc_id").orderBy("range_no")
    least = max(1, (range_bytes - min(HALO, range_bytes // 2)) // tokenizer(at).longest)  # tokens of a range but the last
    so_far = line.rowsBetween(Window.unboundedPreceding, -1)
    n, zero = F.octet_length("marks").cast("long"), F.lit(0).cast("long")

    def sides(c: Column, span: tuple[int, int]) -> Column:
        return F.collect_list(c).over(line.rowsBetween(*span))

    ends = tokens.select(  # a few hundred bytes a range, not its data
        *keys, n.alias("n"), F.col("size").cast("long").alias("size"), F.substring("widths", 1, 2 * most).alias("hw"), F.substring("marks", 1, most).alias("hm"),
        F.expr(f"substring(widths, greatest(octet_length(widths) - {2 * shared - 1}, 1), {2 * shared})").alias("t"),
    )
    next_, last = (1, math.ceil(most / least)), (-math.ceil(shared / least) - 1, -1)
    beside = ends.select(
        *keys, F.coalesce(F.sum("n").over(so_far), zero).alias("before"), F.coalesce(F.sum("size").over(so_far), zero).alias("byte"), F.sum("n").over(Window.partitionBy("doc_id")).alias("total"),
        sides(F.col("hw"), next_).alias("head_widths"), sides(F.col("hm"), next_).alias("head_marks"), sides(F.col("t"), last).alias("tails"),
    ).where(F.col("total") > most)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = []
            for r in b.to_pylist():
                _, marks, _, n = _around(r, most, shared)
                to = jumps(marks, n, r["before"], r["total"], most, shared).tolist()
                step = [(0, 0)] * n
                for e in range(n - 1, -1, -1):
                    step[e] = (to[e] - n, 1) if to[e] >= n else (step[to[e]][0], step[to[e]][1] + 1)
                steps.append(np.array(step[:most], STEP).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("range_no"), pa.array([len(m) for m in b.column("marks").to_pylist()], pa.int32()), pa.array(steps, pa.binary())], names=[*keys, "n", "steps"])

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, enters, k = None, 0, 0
        for b in batches:
            out = []
            for own, no, n, steps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != doc:
                    doc, enters, k = own, 0, 0
                out.append((own, no, enters, k))
                if enters < n:
                    leaves, pieces = np.frombuffer(steps, STEP)[enters].tolist()
                    enters, k = leaves, k + pieces
                else:
                    enters -= n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32())], names=[*keys, "enters", "k"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter()
        for b in batches:
            for r in b.to_pylist():
                widths, marks, tail, n = _around(r, most, shared)
                place = np.concatenate([[0], np.cumsum(widths)])
                place = place - place[tail] + r["lead"]  # in data, of token i - tail
                to = jumps(marks, n, r["before"], r["total"], most, shared)
                e, k = r["enters"], r["k"]
                while e < n:
                    end, start = int(to[e]), max(e + r["before"] - shared, 0) - r["before"]
                    level = END if end + r["before"] == r["total"] else int(marks[end] & LEVEL)
                    out.add(r["doc_id"], k, start + r["before"], end - start, r["data"], int(place[start + tail]), r["byte"] - r["lead"], int(place[end + tail]), level)
                    e, k = end, k + 1
            yield from out.take(BATCH_BYTES)
        yield from out.take()

    beside = materialize(beside, "beside")
    steps = beside.drop("byte", "tails", "head_widths").withColumns({"tails": F.array().cast("array<binary>"), "head_widths": F.array().cast("array<binary>")})
    steps = tokens.select(*keys, "widths", "marks").join(steps, keys).mapInArrow(tables, "doc_id BIGINT, range_no INT, n INT, steps BINARY")
    walk = spread(steps, ["doc_id"]).sortWithinPartitions(*keys).mapInArrow(stitched, "doc_id BIGINT, range_no INT, enters BIGINT, k INT")
    return tokens.join(beside.join(walk, keys), keys).mapInArrow(emit, PIECES)


def _checked(most: int, shared: int) -> None:
    if not 0 <= shared < most // 2:
        raise ValueError("shared must be less than half of most")


def pieces(docs: DataFrame, most: int = MOST, shared: int = SHARED, range_bytes: int = RANGE_BYTES, path: str | None = None) -> DataFrame:
    """Pieces of each oversized text: doc_id, piece_no, start_token, n_tokens, start_byte, end_byte, cut (what
    the piece ends with), text. ``range_bytes`` doesn't change them.

    A piece is tokens [start_token, start_token + n_tokens) of the text, at most ``most``; the next begins
    ``shared`` tokens before its end (a text's first tokens, if a piece is shorter than that). Without the
    shared tokens the pieces put together are the text. Where a shared start is inside a character, ``text``
    has the whole character. Defined cases: null, empty and short texts have no pieces; a text without any
    boundary is cut after ``most`` tokens, between characters; doc_id must be unique, as the ranges of a text
    are put together by it.
    """
    _checked(most, shared)
    at = path or vocabulary_path()
    longest = tokenizer(at).longest
    rows = docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "utf-8").alias("bytes"))
    rows, size = rows.where(F.octet_length("bytes") > most), F.octet_length("bytes")
    ranges = text_ranges(rows.where(size > range_bytes), range_bytes, max(shared * longest, 4 * CONTEXT), most * longest)
    return _short(rows.where(size <= range_bytes), most, shared, at).unionByName(_long(ranges, most, shared, range_bytes, at))


def file_pieces(files: DataFrame, most: int = MOST, shared: int = SHARED, range_bytes: int = RANGE_BYTES, path: str | None = None) -> DataFrame:
    """The same of UTF-8 files ``doc_id, path``, which are read by byte ranges and never as a whole. Bytes that are no text are
    U+FFFD, and offsets count those. An empty file has no pieces; a file that isn't there is an error."""
    _checked(most, shared)
    at = path or vocabulary_path()
    longest = tokenizer(at).longest
    ranges = file_ranges(files, range_bytes, max(shared * longest, 4 * CONTEXT), most * longest)
    return _long(ranges, most, shared, range_bytes, at)


def oversized(docs: DataFrame, most: int = MOST, range_bytes: int = RANGE_BYTES, path: str | None = None, shared: int = SHARED) -> DataFrame:
    """doc_id and n_tokens of the texts of more than ``most`` tokens, from their pieces."""
    own = pieces(docs, most, min(shared, (most - 1) // 4), range_bytes, path)
    return own.groupBy("doc_id").agg(F.max(F.col("start_token") + F.col("n_tokens")).alias("n_tokens"))
