import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from maskloom.operators import shred as S


def brute(bodies):
    """Links by walking each document."""
    out = set()

    def visit(i, x, video, annotation):
        if isinstance(x, list):
            for y in x:
                visit(i, y, video, annotation)
        elif isinstance(x, dict):
            for k, v in x.items():
                items = [e for e in (v if isinstance(v, list) else [v]) if isinstance(e, dict)]
                if k == "videos":
                    for e in items:
                        own = S.whole(e.get("id"))
                        if own is not None:
                            out.add((i, "video", None, own))
                        visit(i, e, own, annotation)
                elif k == "annotations":
                    for e in items:
                        own, at = S.whole(e.get("id")), S.whole(e.get("video_id"))
                        at = video if at is None else at
                        if own is not None and at is not None:
                            out.add((i, "annotation", at, own))
                        visit(i, e, video, own)
                elif k == "segmentations":
                    listed = v if isinstance(v, list) else [v] if isinstance(v, dict) else []
                    for p, e in enumerate(listed):
                        if e is not None and annotation is not None:
                            out.add((i, "segmentation", annotation, p))
                        visit(i, e, video, annotation)
                else:
                    visit(i, v, video, annotation)

    for i, b in enumerate(bodies):
        visit(i, S.parse(b), None, None)
    return out


ids = st.one_of(st.integers(1, 5), st.sampled_from(["3", " 4 ", "x", None, 2.0, True, 1.5]))
segments = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.just({"counts": "1"}), st.just([[1, 2]]), st.just(7)), max_size=3), st.just({"counts": "0"}))
annotation = st.fixed_dictionaries({}, optional={"id": ids, "video_id": ids, "segmentations": segments, "note": st.text(max_size=3)})
annotations = st.one_of(st.none(), annotation, st.lists(st.one_of(annotation, st.none()), max_size=3))
video = st.fixed_dictionaries({}, optional={"id": ids, "annotations": annotations, "file_names": st.lists(st.text(max_size=2), max_size=2)})
document = st.fixed_dictionaries({}, optional={"videos": st.one_of(st.none(), video, st.lists(st.one_of(video, st.none(), st.integers()), max_size=3)), "annotations": annotations, "data": st.fixed_dictionaries({}, optional={"videos": st.lists(video, max_size=2), "annotations": annotations}), "more": st.lists(st.fixed_dictionaries({}, optional={"videos": st.lists(video, max_size=2)}), max_size=2)})


@settings(max_examples=150, deadline=None)
@given(st.lists(document, max_size=4))
def test_links_equal_a_walk(documents):
    bodies = [json.dumps(d) for d in documents]
    assert set(S.dataset_links(bodies)) == brute(bodies)


def test_broken_bodies():
    bodies = [None, "", "{", "[]", "null", "3", '{"videos": {"id": "7"}}', '{"videos": [{"id": 1}]} x', "[" * 100_000, '{"a":' * 3000 + '{"videos":{"id":9}}' + "}" * 3000]
    links = set(S.dataset_links(bodies))
    assert (6, "video", None, 7) in links and {i for i, *_ in links} <= {6, 9}


def test_levels_are_those_of_the_definition():
    root = S.shred(['{"videos": [{"id": 1, "segmentations": [null, {"a": 2}]}, {"segmentations": []}]}', "{}"], S.LISTS)
    a = {n.path: c for n, c in S.levels(root, 2).items()}["$.videos[].segmentations[].a"]
    assert (a.rep.tolist(), a.dfn.tolist(), a.values) == ([0, 2, 1, 0], [4, 6, 3, 0], [None, 2, None, None])
    t = {n.path: t for n, t in S.assemble(root).items()}["$.videos[].segmentations[]"]
    assert np.array_equal(t.parent_row, [0, 0]) and np.array_equal(t.position, [0, 1]) and np.array_equal(t.is_null, [True, False])


def test_frames(spark):
    rows = [(1, '{"videos": [{"id": 5, "annotations": [{"id": 6, "segmentations": [null, 1]}]}]}', "x"), (2, None, "x"), (3, "{", "x")]
    df = spark.createDataFrame(rows, "record_id BIGINT, body STRING, child_id STRING")
    assert {tuple(r) for r in S.nested_links(df).collect()} == {(1, "video", 1, 5), (1, "annotation", 5, 6), (1, "segmentation", 6, 1)}
    tables = {(r.list_name, r.row_no): r for r in S.nested_tables(df).collect()}
    assert tables["annotations", 0].fields == {"id": "6"} and tables["annotations", 0].parent_row_no == 0
    assert tables["segmentations", 0].is_null and not tables["segmentations", 1].is_null
    assert S.level_columns(df.coalesce(1)).where("path = '$.videos[].id'").count() == 3
    assert S.nested_links(df.limit(0)).count() == 0


def test_bodies_nested_deeply(spark):
    deep = 40_000
    inner = '{"videos": [{"id": 1, "annotations": {"id": 2}}]}'
    bodies = ["[" * deep + inner + "]" * deep, '{"a":' * deep + inner + "}" * deep, '{"videos": [' * deep + inner + "]}" * deep, '{"x": ' + "[" * deep + "]" * deep + ', "videos": {"id": 1}}', "[" * deep]
    links = set(S.dataset_links(bodies))
    for k in range(3):
        assert {(k, "video", None, 1), (k, "annotation", 1, 2)} <= links
    assert (3, "video", None, 1) in links and not any(i == 4 for i, *_ in links)
    df = spark.createDataFrame(list(enumerate([*bodies[1:2], *bodies[3:], None, " ", "{}"])), "record_id BIGINT, body STRING")
    assert {tuple(r) for r in S.broken_bodies(df).collect()} == {(2, "broken"), (3, "null"), (4, "empty")}
    assert S.nested_links(df).count() == 3 and S.nested_tables(df).where("list_name = 'videos'").count() == 2


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False), st.text(max_size=5)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=3), x, max_size=3)), max_leaves=12), st.integers(0, 200), st.sampled_from(["", "]", "}", ",", '"', "1", " "]))
def test_the_parser_without_recursion(value, cut, more):
    text = json.dumps(value)
    assert S.parsed(text) == value and S.parsed(f" {text}\n") == value
    for broken in (text[:cut] + more + text[cut:], text[: max(0, len(text) - cut % 7)]):
        try:
            want = json.loads(broken)
        except ValueError:
            want = ValueError
        try:
            got = S.parsed(broken)
        except ValueError:
            got = ValueError
        assert got == want


def test_work_follows_the_bodies_not_the_paths():
    """Names of fields that are data: entries are as many as values, whatever the number of paths."""
    bodies = [json.dumps({f"k{i}_{j}": {"videos": [{"id": i * 50 + j, "x": 1}]} for j in range(50)}) for i in range(400)]
    root = S.shred(bodies, S.LISTS)
    assert sum(len(n.column.rep) for n in S.walk(root)) <= 400 + 400 * 50 * 5
    assert sum(len(t.record) for t in S.assemble(root).values()) == 20_000
    assert len(set(S.dataset_links(bodies))) == 20_000
