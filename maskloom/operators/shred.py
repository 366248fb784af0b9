"""Nested records as related flat tables, by columnar shredding.

Bodies are JSON of no fixed schema. Per Arrow batch the union of their shapes becomes a tree of paths; each path
becomes a column of (value, repetition level, definition level):

* The *depth* of a path is its number of steps, ``.name`` or ``[]``. The definition level of an entry is
  the number of steps that exist, one more if the value at the end is not null.
* The repetition level tells at which ``[]`` of the path, counted from 1, the entry repeats; 0 starts a
  record.

Entries of absent paths are not written one by one: an entry tells the length of the run of nulls before it, whose
levels are those of the path around it. So a batch costs what its bodies hold, however many paths it has, also where
the names of fields are data.

Tables come back from these columns alone, with numpy: an entry starts a list if its repetition level is less than
the list's, and run lengths and starts add up to the number of the instance around it; an entry is an element if its
definition level reaches the ``[]``. A record lies within one batch, so nothing is shuffled.

Nothing here is recursive: a body may be nested as deeply as its text goes.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WHOLE = re.compile(r"\s*[+-]?\d+(\.0*)?\s*\Z", re.ASCII)
TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null|NaN|-?Infinity)\b))', re.ASCII)


class Column:
    """Entries of one path. ``gap``: the nulls before an entry; ``length``: all entries so far, ``synced``: entries of the
    path around it that are accounted for."""

    __slots__ = ("values", "rep", "dfn", "gap", "length", "synced")

    def __init__(self) -> None:
        self.values: list = []
        self.rep: list[int] = []
        self.dfn: list[int] = []
        self.gap: list[int] = []
        self.length = self.synced = 0

    def add(self, value: Any, rep: int, dfn: int, gap: int) -> int:
        """Append an entry and tell its place."""
        self.values.append(value)
        self.rep.append(rep)
        self.dfn.append(dfn)
        self.gap.append(gap)
        self.length += gap + 1
        return self.length - 1

    def places(self) -> np.ndarray:
        """The place of each entry, runs of nulls counted."""
        return np.cumsum(np.asarray(self.gap, np.int64) + 1) - 1

    def lists(self, level: int) -> np.ndarray:
        """Of a ``[]`` of that level: the entry of the path around it to which each entry belongs."""
        return np.cumsum(np.asarray(self.gap, np.int64) + (np.asarray(self.rep, np.int64) < level)) - 1


class Node:
    """A path of the batch's schema."""

    __slots__ = ("name", "parent", "depth", "rep", "fields", "elem", "column", "plain", "around", "outer")

    def __init__(self, name: str, parent: Node | None, depth: int, rep: int, around: Node | None):
        self.name, self.parent, self.depth, self.rep = name, parent, depth, rep
        self.around = around  #: the nearest [] at or above this path
        self.outer: Node | None = None  #: of a []: the [] around its list
        self.fields: dict[str, Node] = {}
        self.elem: Node | None = None
        self.column = Column()
        self.plain = False  #: whether there are values at this path

    def child(self, name: str) -> Node:
        if name not in self.fields:
            self.fields[name] = Node(name, self, self.depth + 1, self.rep, self.around)
        return self.fields[name]

    def element(self) -> Node:
        if self.elem is None:
            name = f"{self.name}[]" if self.around is self else self.name
            self.elem = Node(name, self, self.depth + 1, self.rep + 1, None)
            self.elem.around, self.elem.outer = self.elem, self.around
        return self.elem

    def below(self, top: Node | None) -> str:
        """The path from ``top`` on."""
        steps, at = [], self
        while at is not top and at is not None:
            steps.append("[]" if at.around is at else at.name if at.parent is None else f".{at.name}")
            at = at.parent
        return "".join(reversed(steps))

    @property
    def path(self) -> str:
        return self.below(None)


class Lists:
    """Which lists repeat: those of the given names, of one element where a bare object stands for the list, and all
    that hold objects. Other lists are plain values."""

    def __init__(self, names: frozenset[str]):
        self.names = names
        self.known: dict[int, bool] = {}  #: lists that hold objects, by identity; of one document

    def holds(self, value: list) -> bool:
        if id(value) in self.known:
            return True
        path, todo = [], [iter((value,))]
        while todo:  # depth first, with the lists on the way down
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
                if path:
                    path.pop()
                continue
            path.append(x)
            inner = []
            for y in x:
                if isinstance(y, dict):
                    self.known.update((id(z), True) for z in path)
                    return True
                if isinstance(y, list):
                    inner.append(y)
            todo.append(iter(inner))
        return False

    def repeats(self, name: str | None, value: Any) -> list | None:
        if name in self.names:
            return value if isinstance(value, list) else [value] if isinstance(value, dict) else None
        return value if isinstance(value, list) and self.holds(value) else None


def write(root: Node, record: int, document: Any, lists: Lists, fields: frozenset[str] | None) -> None:
    """Append the entries of a document. ``fields``: names of the values that are asked for; None: all."""
    lists.known.clear()
    todo: list[tuple] = [(root, None, document, 0, record, False)]  # ..., entry around it or gap, whether an element
    while todo:
        node, name, value, rep, at, is_element = todo.pop()
        listed = lists.repeats(name, value)
        inner = isinstance(value, dict)
        plain = value is not None and listed is None and not inner
        if is_element:
            at = node.column.add(value if plain else None, rep, node.depth + (value is not None), at)
        else:
            node.column.add(value if plain else None, rep, node.depth + plain, at - node.column.length)
        node.plain |= plain
        if listed is not None:
            element = node.element()
            gap, element.column.synced = at - element.column.synced, at + 1
            if listed:
                todo += [(element, None, x, element.rep, 0, True) for x in reversed(listed[1:])]
                todo.append((element, None, listed[0], rep, gap, True))
            else:
                element.column.add(None, rep, node.depth, gap)
        elif inner:
            for k, v in reversed(value.items()):
                if fields is None or k in fields or isinstance(v, (dict, list)):
                    todo.append((node.child(k), k, v, rep, at, False))


def parsed(text: str) -> Any:
    """JSON of any depth, by a stack; ValueError if it isn't complete."""
    out: list = []
    stack, names, state = [out], [""], "value"
    at, end = 0, len(text)
    while True:
        m = TOKEN.match(text, at)
        if m is None:
            if text[at:].strip(" \t\n\r") or state != "after" or len(stack) > 1:
                raise ValueError(f"no JSON at {at}")
            return out[0]
        at, (mark, scalar), top = m.end(), m.groups(), stack[-1]
        if mark in ("]", "}") and (state == "after" or state == f"first {mark}") and len(stack) > 1 and isinstance(top, dict if mark == "}" else list):
            stack.pop()
            names.pop()
            state = "after"
        elif state in ("value", "first ]") and (scalar or mark in ("[", "{")):
            value = json.loads(scalar) if scalar else [] if mark == "[" else {}
            if isinstance(top, dict):
                top[names[-1]] = value
            else:
                top.append(value)
            if scalar:
                state = "after"
            else:
                stack.append(value)
                names.append("")
                state = "first ]" if mark == "[" else "first }"
        elif state in ("name", "first }") and scalar and scalar[0] == '"':
            names[-1], state = json.loads(scalar), "colon"
        elif state == "colon" and mark == ":":
            state = "value"
        elif state == "after" and mark == "," and len(stack) > 1:
            state = "name" if isinstance(top, dict) else "value"
        else:
            raise ValueError(f"no JSON at {at} of {end}")


def load(body: str) -> Any:
    """The document; ValueError for a body that isn't complete JSON."""
    if sys.get_int_max_str_digits():
        sys.set_int_max_str_digits(0)  # numbers of any length are JSON
    try:
        return json.loads(body)
    except RecursionError:
        return parsed(body)


def parse(body: str | None) -> Any:
    """The document, or None for a body that is null or no complete JSON (see ``fault``)."""
    try:
        return None if body is None else load(body)
    except ValueError:
        return None


def fault(body: str | None) -> str | None:
    """Why a body has no document: ``null``, ``empty`` or ``broken``; None if it has one."""
    if body is None:
        return "null"
    if not body.strip():
        return "empty"
    try:
        load(body)
    except ValueError:
        return "broken"
    return None


def shred(bodies: list[str | None], lists: frozenset[str], fields: frozenset[str] | None = None) -> Node:
    """The batch's schema with its columns; the root has an entry a body."""
    root, own = Node("$", None, 0, 0, None), Lists(lists)
    for k, b in enumerate(bodies):
        write(root, k, parse(b), own, fields)
    return root


def walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        if node.elem is not None:
            todo.append(node.elem)
        todo += reversed(node.fields.values())


@dataclass
class Levels:
    """A column with its runs of nulls written out."""

    values: list
    rep: np.ndarray
    dfn: np.ndarray


def levels(root: Node, n: int) -> dict[Node, Levels]:
    """All columns of ``n`` bodies in full: as large as paths times bodies, for looking at a batch."""
    out: dict[Node, Levels] = {}
    for node in walk(root):
        c = node.column
        own_rep, own_dfn, at = np.asarray(c.rep, np.int64), np.asarray(c.dfn, np.int64), c.places()
        if node.parent is None:
            rep, dfn = np.zeros(n, np.int64), np.zeros(n, np.int64)
        else:
            around = out[node.parent]
            rep, dfn = around.rep, np.minimum(around.dfn, node.parent.depth)
            if node.around is node:
                times = np.ones(len(rep), np.int64)
                lists, many = np.unique(c.lists(node.rep), return_counts=True)
                times[lists] = many
                rep, dfn = np.repeat(rep, times), np.repeat(dfn, times)
        rep, dfn, values = rep.copy(), dfn.copy(), np.full(len(rep), None, object)
        rep[at], dfn[at] = own_rep, own_dfn
        for k, v in zip(at.tolist(), c.values, strict=True):
            values[k] = v
        out[node] = Levels(values.tolist(), rep, dfn)
    return out


@dataclass
class FlatTable:
    """Instances of one ``[]``: per row the record, the row of the instance around it (of ``parent``, -1 if there is
    none), the position in its list, whether the element is null, and of each path below it the rows that have a value."""

    node: Node
    parent: Node | None
    record: np.ndarray
    parent_row: np.ndarray
    position: np.ndarray
    is_null: np.ndarray
    place: np.ndarray
    columns: list[tuple[Node, np.ndarray, list]]

    def values(self, name: str) -> list:
        """The field ``name`` of each row."""
        out: list = [None] * len(self.record)
        node = self.node.fields.get(name)
        for own, rows, values in self.columns:
            if own is node:
                for r, v in zip(rows.tolist(), values, strict=True):
                    out[r] = v
        return out


def assemble(root: Node) -> dict[Node, FlatTable]:
    """One table per repeated ancestor, from the level sequences of the columns."""
    tables: dict[Node, FlatTable] = {}
    for node in walk(root):
        c = node.column
        if node.around is node:
            rep, dfn, place = np.asarray(c.rep, np.int64), np.asarray(c.dfn, np.int64), c.places()
            at, around = dfn >= node.depth, c.lists(node.rep)[dfn >= node.depth]
            starts = np.where(rep < node.rep, np.arange(len(rep)), 0)
            position = np.arange(len(rep)) - np.maximum.accumulate(starts)
            outer = None if node.outer is None else tables[node.outer]
            row = np.full(len(around), -1) if outer is None else np.searchsorted(outer.place, around)
            record = around if outer is None else outer.record[row]
            tables[node] = FlatTable(node, node.outer, record, row, position[at], (dfn == node.depth)[at], place[at], [])
        if node.plain and node.around is not None:
            table, there = tables[node.around], [k for k, v in enumerate(c.values) if v is not None]
            table.columns.append((node, np.searchsorted(table.place, c.places()[there]), [c.values[k] for k in there]))
    return tables


def whole(value: Any) -> int | None:
    """A BIGINT from a whole number, also one written as text; None otherwise."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        if not WHOLE.match(value):
            return None
        value = int(value.strip().partition(".")[0])
    elif isinstance(value, float):
        if not value.is_integer():
            return None
        value = int(value)
    return value if isinstance(value, int) and -(1 << 63) <= value < 1 << 63 else None


def ancestor_rows(tables: dict[Node, FlatTable], table: FlatTable, name: str) -> tuple[FlatTable | None, np.ndarray]:
    """The nearest table around ``table`` that is named ``name``, and each row's row there."""
    rows, at = np.arange(len(table.record)), table
    while at.parent is not None:
        rows = at.parent_row[rows]
        at = tables[at.parent]
        if at.node.name == name:
            return at, rows
    return None, rows


LISTS = frozenset({"videos", "annotations", "segmentations"})
FIELDS = frozenset({"id", "video_id"})


def dataset_links(bodies: list[str | None]) -> Iterator[tuple[int, str, int | None, int]]:
    """(index of the body, link_kind, parent, child) of dataset documents; parent is None for videos."""
    tables = {n: t for n, t in assemble(shred(bodies, LISTS, FIELDS)).items()}
    ids = {n: [whole(v) for v in t.values("id")] for n, t in tables.items() if n.name in LISTS}
    for n, t in tables.items():
        if n.name == "videos":
            yield from ((r, "video", None, i) for r, i in zip(t.record.tolist(), ids[n], strict=True) if i is not None)
        elif n.name == "annotations":
            around, row = ancestor_rows(tables, t, "videos")
            own = [whole(v) for v in t.values("video_id")]
            for k, i in enumerate(ids[n]):
                video = own[k]
                if video is None and around is not None:
                    video = ids[around.node][row[k]]
                if i is not None and video is not None:
                    yield int(t.record[k]), "annotation", video, i
        elif n.name == "segmentations":
            around, row = ancestor_rows(tables, t, "annotations")
            if around is not None:
                for k in np.flatnonzero(~t.is_null):
                    if (i := ids[around.node][row[k]]) is not None:
                        yield int(t.record[k]), "segmentation", i, int(t.position[k])


BATCH, BATCH_BYTES = 2_000, 1 << 24  #: bodies, and their bytes, shredded together


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str | None]]]:
    for b in batches:
        keys, bodies, size = [], [], 0
        for k, body in zip(b.column(0), b.column(1), strict=True):
            n = len(body.as_buffer()) if body.is_valid else 0
            if keys and (len(keys) == BATCH or size + n > BATCH_BYTES):
                yield keys, bodies
                keys, bodies, size = [], [], 0
            keys.append(k.as_py())
            bodies.append(body.as_py())
            size += n
        if keys:
            yield keys, bodies


def nested_links(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """Parent-child links of the dataset documents in ``body``: record_id, link_kind, parent_id, child_id.

    ``videos`` and ``annotations`` may stand anywhere, as list or bare object; ids may be written as text.
    An annotation's video is its ``video_id``, else the video around it; without either it has no link to a
    video, its segmentations still are linked to it. What a body states twice comes once. Null, empty and
    broken bodies have no links. ``key`` should be unique; a repeated key's bodies count one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in _batches(batches):
            seen = dict.fromkeys((i, kind, keys[i] if parent is None else parent, child) for i, kind, parent, child in dataset_links(bodies))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i, *_ in seen], pa.int64()),
                    pa.array([x[1] for x in seen], pa.string()),
                    pa.array([x[2] for x in seen], pa.int64()),
                    pa.array([x[3] for x in seen], pa.int64()),
                ],
                names=["record_id", "link_kind", "parent_id", "child_id"],
            )

    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{body}` AS STRING) AS b")
    return rows.mapInArrow(run, "record_id BIGINT, link_kind STRING, parent_id BIGINT, child_id BIGINT")


def _text(value: Any) -> str:
    if isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:  # a list of lists, of any depth
        out, todo = [], [value]
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo.append("]")
                for k, y in enumerate(reversed(x)):
                    todo += ["," if k else "", y if isinstance(y, list) else json.dumps(y, ensure_ascii=False)]
                out.append("[")
            else:
                out.append(x)
        return "".join(out)


def broken_bodies(df: DataFrame, key: str = "record_id", body: str = "body") -> DataFrame:
    """Bodies that have no document: record_id, reason (``null``, ``empty``, ``broken``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in _batches(batches):
            reasons = [fault(b) for b in bodies]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, r in zip(keys, reasons, strict=True) if r], pa.int64()), pa.array([r for r in reasons if r], pa.string())], names=["record_id", "reason"])

    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{body}` AS STRING) AS b")
    return rows.mapInArrow(run, "record_id BIGINT, reason STRING")


def nested_tables(df: DataFrame, lists: tuple[str, ...] = tuple(sorted(LISTS)), key: str = "record_id", body: str = "body") -> DataFrame:
    """All tables of the bodies in one frame, a row per element of a repeated list: record_id, path,
    list_name, row_no (of the path in the record), parent_path and parent_row_no (null at the top),
    position, is_null, fields (leaf path below the element -> value as text). Filter by ``list_name`` for
    one table. Nulls as in ``nested_links``; field names are map keys, so they can't clash with columns.
    """
    wanted = frozenset(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.int64()), ("path", pa.string()), ("list_name", pa.string()), ("row_no", pa.int32()), ("parent_path", pa.string()), ("parent_row_no", pa.int32()), ("position", pa.int32()), ("is_null", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string()))]
        )
        for keys, bodies in _batches(batches):
            tables = assemble(shred(bodies, wanted))
            first = {node: np.searchsorted(t.record, np.arange(len(bodies))) for node, t in tables.items()}
            for node, t in tables.items():
                n, path = len(t.record), node.path
                row_no = np.arange(n) - first[node][t.record]
                parent = t.parent_row - first[t.parent][t.record] if t.parent else None
                fields: list[list] = [[] for _ in range(n)]
                for own, rows, values in t.columns:
                    name = own.below(node)[1:] or "value"
                    for r, v in zip(rows.tolist(), values, strict=True):
                        fields[r].append((name, _text(v)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[r] for r in t.record], pa.int64()), pa.array([path] * n, pa.string()), pa.array([node.name] * n, pa.string()),
                        pa.array(row_no, pa.int32()), pa.array([t.parent and t.parent.path] * n, pa.string()), pa.array(parent, pa.int32()) if t.parent else pa.nulls(n, pa.int32()),
                        pa.array(t.position, pa.int32()), pa.array(t.is_null), pa.array(fields, pa.map_(pa.string(), pa.string())),
                    ],
                    schema=schema,
                )
        
    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{body}` AS STRING) AS b")
    return rows.mapInArrow(
        run, "record_id BIGINT, path STRING, list_name STRING, row_no INT, parent_path STRING, parent_row_no INT, position INT, is_null BOOLEAN, fields MAP<STRING, STRING>"
    )


def level_columns(df: DataFrame, lists: tuple[str, ...] = tuple(sorted(LISTS)), key: str = "record_id", body: str = "body") -> DataFrame:
    """The shredded columns themselves: record_id, path, entry_no (in record and path), rep, def, value. A record
    has entries for the paths of its batch; a path no record of the batch has is not there."""
    wanted = frozenset(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in _batches(batches):
            for node, full in levels(shred(bodies, wanted), len(bodies)).items():
                if not node.plain and node.around is not node:
                    continue
                rep, path = full.rep, node.path
                record = np.cumsum(rep == 0) - 1
                starts = np.flatnonzero(rep == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[r] for r in record], pa.int64()), pa.array([path] * len(rep), pa.string()), pa.array(np.arange(len(rep)) - starts[record], pa.int32()),
                        pa.array(rep, pa.int32()), pa.array(full.dfn, pa.int32()), pa.array([None if v is None else _text(v) for v in full.values], pa.string()),
                    ],
                    names=["record_id", "path", "entry_no", "rep", "def", "value"],
                )
        
    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{body}` AS STRING) AS b")
    return rows.mapInArrow(run, "record_id BIGINT, path STRING, entry_no INT, rep INT, def INT, value STRING")
