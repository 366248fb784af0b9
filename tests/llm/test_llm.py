import base64
import datetime as dt
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskloom.llm import packing, sampling, splitting, terms, tokens, topn

PATH = tokens.vocabulary_path()
OWN = tokens.tokenizer(PATH)
T = lambda d: dt.datetime(2025, 1, d)
TEXTS = ["", " ", "a", "Hello, world!\n\nIt's 12 o'clock.  ", "第28帧：镜子超过茶壶。", "الإطار 43: الإبريق", "<|endoftext|> is text", "é" * 300, "👍🏽 x", "\u0000 "]


# Tokens


def test_byte_table():
    table = tokens.byte_characters()
    assert len(set(table)) == 256 and table[ord("A")] == "A" and table[ord(" ")] == "Ġ" and table[ord("\n")] == "Ċ"


def test_same_ids_as_the_other_library():
    tiktoken = pytest.importorskip("tiktoken")
    sys.path.insert(0, "/opt")
    import public_tokenizers as public

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert list(OWN.encode(TEXTS)) == [other.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.integers(0, 60), st.integers(0, 60))
def test_round_trip_offsets_and_split_characters(text, i, j):
    (ids,) = OWN.encode([text])
    assert OWN.decode(ids) == text
    a, b = sorted((min(i, len(ids)), min(j, len(ids))))
    assert "".join(OWN.decode_parts([ids[:a], ids[a:b], ids[b:]])) == text
    first, last = OWN.spans(ids) if ids else ([], [])
    for k, t in enumerate(ids):
        assert OWN.token_bytes[t] in text[first[k] : last[k]].encode()
    assert not ids or (first[0] == 0 and last[-1] == len(text))


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id BIGINT, text STRING, ids STRING")
    ids = tokens.token_ids(F.col("text"))
    got = df.select("doc_id", ids.alias("i"), tokens.token_count(F.col("text")).alias("n")).withColumn("back", tokens.decoded(F.col("i"))).withColumn("spans", tokens.token_spans(F.col("i"))).collect()
    for r in got:
        text = ([*TEXTS, None][r.doc_id]) or ""
        assert list(r.i) == next(OWN.encode([text])) and r.n == len(r.i) == len(r.spans) and r.back == text
    bad = spark.range(1).select(tokens.token_ids(F.expr("CAST(X'61FF' AS STRING)")).alias("i")).first().i
    assert OWN.decode(bad) == "a�"
    assert df.limit(0).select(ids).count() == 0


def test_very_long_texts(spark):
    texts = ["x" * 200_000, "word, " * 100_000, "茶壶很湿。" * 40_000, "\n" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")
    counts = {r.doc_id: r.n for r in df.select("doc_id", tokens.token_count(F.col("text")).alias("n")).collect()}
    assert counts == dict(enumerate(len(i) for i in OWN.encode(texts)))
    assert {r.doc_id: r.n_tokens for r in splitting.oversized(df).collect()} == {i: n for i, n in counts.items() if n > 512}
    by = defaultdict(list)
    for p in splitting.pieces(df).collect():
        by[p.doc_id].append(p)
    for i, own in by.items():
        check_pieces(texts[i], own, 512, 32)


# Packing


def pack(spark, rows, capacity=50, **options):
    out = packing.pack(spark.createDataFrame(rows, "doc_id BIGINT, source STRING, n_tokens INT, container_id STRING"), capacity, **options).collect()
    used, pieces = Counter(), defaultdict(list)
    for r in out:
        used[r.container_id] += r.n_tokens
        pieces[r.doc_id].append((r.piece_no, r.start_token, r.n_tokens))
    assert all(v <= capacity for v in used.values())
    return out, used, pieces


@pytest.mark.parametrize("chunk_rows", [100_000, 200, 13])
def test_packing_is_whole_and_tight(spark, chunk_rows):
    rng = np.random.default_rng(2)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", int(rng.integers(0, 30)) if i % 50 else 177, "x") for i in range(2000)]
    out, used, pieces = pack(spark, rows, chunk_rows=chunk_rows)
    for i, _, n, _ in rows:
        own = sorted(pieces[i])
        assert sum(p[2] for p in own) == n and [p[0] for p in own] == list(range(len(own)))
        assert len(own) == max(1, -(-n // 50)) and [p[1] for p in own] == [50 * k for k in range(len(own))]
    least = sum(r[2] for r in rows) / 50
    assert len(used) <= least * 1.01 + 2


def test_mixture_follows_targets(spark):
    rows = [(i, "ab"[i % 2], 5, "x") for i in range(2000)]
    targets = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source STRING, share DOUBLE")
    out, used, _ = pack(spark, rows, targets=targets)
    assert len(used) == 200 and set(used.values()) == {50}
    per = Counter((r.container_id, r.source) for r in out)
    first = [c for c in used if per[c, "b"] and per[c, "a"]]
    assert sum(per[c, "a"] for c in first) == pytest.approx(3 * sum(per[c, "b"] for c in first), rel=0.1)


def test_mixture_is_carried_over_many_chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "abc"[i % 3], int(rng.integers(1, 9)), "x") for i in range(6000)]
    targets = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0), ("d", 4.0)], "source STRING, share DOUBLE")
    placed = packing.pack(spark.createDataFrame(rows, "doc_id BIGINT, source STRING, n_tokens INT, x STRING"), 200, targets, chunk_tokens=1500)
    assert packing.pack(spark.createDataFrame(rows, "doc_id BIGINT, source STRING, n_tokens INT, x STRING"), 200, chunk_tokens=1500).select("container_id").distinct().count() <= sum(r[2] for r in rows) / 200 * 1.01 + 1
    mixed = packing.mixture(placed, targets).collect()
    assert {r.source: r.target for r in mixed} == {"a": 0.25, "b": 0.125, "c": 0.125}
    per = defaultdict(dict)
    for r in mixed:
        per[r.container_id][r.source] = r.share
    filled = [p for p in per.values() if p.get("a", 0) > 0 and p.get("b", 0) > 0 and p.get("c", 0) > 0]
    assert len(filled) > 50  # d has no items: its part goes to the others
    assert np.median([p["a"] for p in filled]) == pytest.approx(0.5, abs=0.05) and np.median([p["b"] for p in filled]) == pytest.approx(0.25, abs=0.05)
    report = {r.source: r for r in packing.deviation(packing.mixture(placed, targets)).collect()}
    assert sum(r.n_tokens for r in report.values()) == sum(r[2] for r in rows) and sum(r.share for r in report.values()) == pytest.approx(1)
    lost = placed.where("doc_id <> 7")
    items = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, n_tokens INT, x STRING")
    assert {r.kind: r.n for r in packing.shortfalls(items, lost, 200).collect()} == {"items": 6000, "missing": 1, "divided": 0, "over": 0}


def test_packing_edges(spark):
    rows = [(1, None, None, "x"), (2, "a", 0, "x"), (2, "a", 0, "x"), (3, "a", 50, "x"), (4, "b", 51, "x"), (5, "b", 1000, "x"), (None, "b", 3, "x")]
    out, used, pieces = pack(spark, rows)
    assert len(out) == 1 + 2 + 1 + 2 + 20 + 1 and len(pieces[2]) == 2 and len(used) == 1 + 1 + 20 + 1
    assert pack(spark, [])[0] == []
    assert packing.pack(spark.createDataFrame(rows, "doc_id BIGINT, source STRING, n_tokens INT, x STRING"), 50, spark.createDataFrame([], "source STRING, share DOUBLE")).count() == len(out)


# Splitting


def check_pieces(text, own, most, shared):
    (ids,) = OWN.encode([text])
    ends, raw, end, at = OWN.ends(ids), text.encode(), 0, 0
    for k, p in enumerate(sorted(own, key=lambda p: p.piece_no)):
        assert p.piece_no == k and 0 < p.n_tokens <= most and p.start_token == (max(0, end - shared) if k else 0)
        end = p.start_token + p.n_tokens
        assert p.end_byte == ends[end - 1] and p.start_byte == (ends[p.start_token - 1] if p.start_token else 0)
        assert raw[at : p.end_byte] and p.text.encode().endswith(raw[p.start_byte : p.end_byte]) and p.text in text
        at = p.end_byte
    assert end == len(ids) and at == len(raw)


@pytest.mark.parametrize("range_bytes", [1 << 16, 300])
def test_pieces(spark, range_bytes):
    long = ["One two three. Four five!\nSix seven eight, nine.\n\n" * 30, "茶壶很湿；风筝不红。镜子，超过茶壶" * 40, "x" * 5000, "é" * 900, "word " * 400, "Привет мир. " * 100, " \n" * 600, "a👍" * 300]
    rows = [(i, t, "x") for i, t in enumerate([*long, "short", "", None])]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, piece_no STRING")
    by = defaultdict(list)
    for p in splitting.pieces(df, 64, 8, range_bytes).collect():
        by[p.doc_id].append(p)
    counts = [len(x) for x in OWN.encode([t or "" for _, t, _ in rows])]
    assert set(by) == {i for i, n in enumerate(counts) if n > 64}
    for i, own in by.items():
        check_pieces(rows[i][1], own, 64, 8)
    assert {(r.doc_id, r.n_tokens) for r in splitting.oversized(df, 64, range_bytes).collect()} == {(i, n) for i, n in enumerate(counts) if n > 64}
    assert all(sorted(own, key=lambda p: p.piece_no)[-1].cut == "end" for own in by.values())
    assert {p.cut for p in by[4]} == {"word", "end"} and "paragraph" in {p.cut for p in by[0]} and "sentence" in {p.cut for p in by[1]}
    assert splitting.pieces(df.limit(0), 64, 8).count() == 0


@pytest.mark.parametrize("most,shared", [(64, 8), (512, 32)])
def test_pieces_do_not_depend_on_the_ranges(spark, most, shared, tmp_path):
    rng = np.random.default_rng(4)
    words = ["dog", "茶壶。", "“Ünd.” ", "a", "\n", "\n\n", " ", "  ", "é" * 9, "12", "x" * 300, "Привет. ", "镜子，", "👍", ".) ", "!\n"]
    texts = ["".join(rng.choice(words, 9000)) + "y" * 2000 + "".join(rng.choice(words, 3000)), "word and " * 4000, "x" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    want = {tuple(r) for r in splitting.pieces(df, most, shared, 1 << 20).collect()}
    for i, t in enumerate(texts):
        check_pieces(t, [splitting_row(r) for r in want if r[0] == i], most, shared)
        (tmp_path / str(i)).write_text(t, newline="")
    files = spark.createDataFrame([(i, str(tmp_path / str(i))) for i in range(len(texts))], "doc_id BIGINT, path STRING")
    for size in (1 << 10, 1 << 12, 1 << 15):
        assert {tuple(r) for r in splitting.pieces(df, most, shared, size).collect()} == want
        assert {tuple(r) for r in splitting.file_pieces(files, most, shared, size).collect()} == want


def splitting_row(values):
    from pyspark.sql import Row

    return Row(*splitting.PIECE.names)(*values)


def test_files_that_are_no_text(spark, tmp_path):
    raw = b"ab \xff\xfe cd. " * 3000
    (tmp_path / "bad").write_bytes(raw)
    (tmp_path / "none").write_bytes(b"")
    files = spark.createDataFrame([(1, str(tmp_path / "bad")), (2, str(tmp_path / "none"))], "doc_id BIGINT, path STRING")
    own = splitting.file_pieces(files, 64, 8, 4096).collect()
    assert {p.doc_id for p in own} == {1}
    check_pieces(raw.decode("utf-8", "replace"), own, 64, 8)


def test_parting_bytes_is_a_token_start():
    text = "ab cd. ef\n\ngh 第28帧：镜子。x"
    raw = text.encode()
    for a in range(len(raw)):
        found = splitting.parting(raw[a:])
        if found is not None:
            at = found
            left, right = raw[: a + at].decode(), raw[a + at :].decode()
            assert list(OWN.encode([left]))[0] + list(OWN.encode([right]))[0] == list(OWN.encode([text]))[0]


# Samples


def test_sample_quotas(spark):
    rows = [(i, 1 if i < 700 else 2 if i < 900 else 3 if i < 905 else None, "x") for i in range(1000)]
    rows += rows[:300] + [(None, 1, "x")]
    targets = spark.createDataFrame([(1, 600, 5), (2, 395, 5), (3, 1, 8), (4, 4, None), (None, 5, 5), (2, 395, 5)], "stratum BIGINT, share_permille INT, min_rows INT")
    s = sampling.StratifiedSample(spark.createDataFrame(rows, "id BIGINT, stratum INT, priority STRING"), targets)
    report = {r.stratum: (r.wanted, r.available, r.quota, r.exhausted) for r in s.report.collect()}
    assert report == {1: (60, 700, 60, False), 2: (40, 200, 40, False), 3: (8, 5, 5, True), 4: (1, 0, 0, True)}
    got = [tuple(r) for r in s.sample.collect()]
    assert len(got) == len(set(got)) == 105 and Counter(g[0] for g in got) == {1: 60, 2: 40, 3: 5}
    again = sampling.StratifiedSample(spark.createDataFrame(rows[::-1], "id BIGINT, stratum INT, priority STRING").repartition(7), targets)
    assert {tuple(r) for r in again.sample.collect()} == set(got)
    none = sampling.StratifiedSample(spark.createDataFrame([], "id BIGINT, stratum INT"), targets)
    assert none.sample.count() == 0 and {r.stratum for r in none.report.collect()} == {1, 2, 3, 4}


def test_sample_is_uniform(spark):
    rows = spark.range(20_000).withColumn("stratum", F.lit(1))
    s = sampling.StratifiedSample(rows, spark.createDataFrame([(1, 1000, 1)], "stratum BIGINT, share_permille INT, min_rows INT"))
    ids = np.array([r.id for r in s.sample.collect()])
    assert len(ids) == 2000 and np.all(np.abs(np.histogram(ids, 10, (0, 20_000))[0] - 200) < 70)


def test_small_reservoirs_give_the_same_sample(spark):
    rows = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 1000 = 1 THEN 2 WHEN id < 20000 THEN 3 END AS stratum")
    targets = spark.createDataFrame([(1, 100, 0), (2, 10, 40), (3, 800, 5), (4, 90, 1)], "stratum BIGINT, share_permille INT, min_rows INT")
    wide = sampling.StratifiedSample(rows, targets, margin=1e9)
    want = {tuple(r) for r in wide.sample.collect()}
    assert wide.passes == 1 and wide.fragments.count() == rows.where("stratum IS NOT NULL").count()
    for margin, parts, held in ((5.0, 4, 1 << 20), (5.0, 4, 500), (0.0, 9, 300)):
        own = sampling.StratifiedSample(rows.repartition(parts), targets, margin=margin, held=held)
        assert {tuple(r) for r in own.sample.collect()} == want
        assert {(r.stratum, r.quota, r.available) for r in own.report.collect()} == {(r.stratum, r.quota, r.available) for r in wide.report.collect()}
        assert margin == 0 or (own.passes == 1 and own.fragments.where("stratum = 1").count() < 1500)
    assert own.passes > 1  # without a margin some task has too few: the pass is made again


# Terms


def brute_terms(records):
    occurrences, within = Counter(), Counter()
    for texts in records.values():
        own = [t for x in texts or [] if x is not None for t in regex.findall(r"[\p{L}\p{N}]+", x.lower())]
        occurrences.update(own)
        within.update(set(own))
    return {t: (occurrences[t], within[t]) for t in occurrences}


def test_signed_deltas(spark):
    schema = "id BIGINT, texts ARRAY<STRING>, deleted BOOLEAN, delivered_at TIMESTAMP, term STRING"
    one = [(1, ["The dog, the DOG", None], False, T(1), "x"), (2, [], False, T(1), "x"), (3, None, False, T(1), "x"), (4, ["café naïve ΣΑΣ", "x1y ²"], None, T(1), "x"), (4, ["café naïve ΣΑΣ", "x1y ²"], False, T(2), "x"), (None, ["lost"], False, T(1), "x"), (5, ["dog"], False, T(1), "x")]
    two = [(1, ["the cat"], False, T(3), "x"), (4, ["café naïve ΣΑΣ", "x1y ²"], False, T(4), "x"), (5, ["dog"], True, T(3), "x"), (6, ["dog dog"], False, T(3), "x"), (7, ["gone"], True, T(3), "x")]
    state = {}
    store = terms.TermCounts(spark)
    for batch in (one, two, []):
        store.apply(spark.createDataFrame(batch, schema))
        store = terms.TermCounts(spark, store.folder)  # taken up from the folder
        for i, texts, deleted, *_ in batch:
            if i is not None:
                state.pop(i, None) if deleted else state.update({i: texts})
        assert {r.term: (r.n_occurrences, r.n_records) for r in store.counts().collect()} == brute_terms(state)
        assert store.n_records() == len(state)
    assert {r.term: r.mark for r in store.marked(1, (1, 3)).collect() if r.mark} == {t: "rare" for t in brute_terms(state)}
    assert terms.TermCounts(spark).counts().count() == 0


def test_order_of_deliveries_does_not_matter(spark):
    rng = np.random.default_rng(6)
    schema = "id BIGINT, texts ARRAY<STRING>, deleted BOOLEAN, delivered_at TIMESTAMP"
    words = ["dog", "cat", "red dog", "old", None]
    rows = [(int(rng.integers(0, 9)), [words[int(rng.integers(0, 5))]], bool(rng.random() < 0.2), T(int(d)) if d else None) for d in rng.integers(0, 28, 90)]
    rows += [(1, ["new text"], False, T(30)), (1, ["old"], False, T(2)), (2, None, True, T(30)), (2, ["dog"], False, T(29))]
    once = terms.TermCounts(spark)
    once.apply(spark.createDataFrame(rows, schema))
    want = {r.term: (r.n_occurrences, r.n_records) for r in once.counts().collect()}
    assert "new" in want
    parts = terms.TermCounts(spark, buckets=4)
    order = rng.permutation(len(rows))
    for k in range(0, len(rows), 10):
        parts.apply(spark.createDataFrame([rows[i] for i in order[k : k + 10]], schema))
    assert len(parts.log) < 10 and parts.buckets == 4
    parts = terms.TermCounts(spark, parts.folder)
    assert {r.term: (r.n_occurrences, r.n_records) for r in parts.counts().collect()} == want and parts.n_records() == once.n_records()


# Best items


def test_top_n_with_ties_and_hot_group(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), i, float(rng.choice([0.0, -0.0, 0.5, 0.5, 1.0, rng.random()])), "x") for i, g in enumerate(rng.choice([1, 1, 1, *range(2, 60)], 3000))]
    rows += rows[:200] + [(1, 9001, None, "x"), (1, 9002, float("nan"), "x"), (None, 9003, 1.0, "x"), (70, None, 1.0, "x"), (71, 9004, float("-inf"), "x"), (72, 9005, float("inf"), "x")]
    df = spark.createDataFrame(rows, "`group` BIGINT, id BIGINT, score DOUBLE, have STRING").repartition(3)
    got, other = defaultdict(list), defaultdict(list)
    for r in topn.top_n(df, 5, (0.95, 0.7, 0.3)).orderBy("group", "rank").collect():
        got[r.group].append((r.id, r.rank))
    for r in topn.top_n(df, 5, (0.95, 0.7, 0.3), broadcast_groups=0).orderBy("group", "rank").collect():
        other[r.group].append((r.id, r.rank))
    assert got == other
    want = {}
    for g in {r[0] for r in rows if r[0] is not None and r[0] != 70}:
        own = sorted({(-r[2], r[1]) for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]})
        want[g] = [(i, k + 1) for k, (_, i) in enumerate(own[:5])]
    assert got == want
    assert topn.top_n(spark.createDataFrame([], "`group` BIGINT, id BIGINT, score DOUBLE")).count() == 0


def test_top_n_of_copies_with_other_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i), float(s)) for g, i, s in zip(rng.integers(0, 4, 4000), rng.integers(0, 12, 4000), rng.integers(0, 40, 4000), strict=True)]
    rows += [(9, 1, 50.0)] * 3000 + [(9, i, 1.0) for i in range(2, 9)]
    best = {}
    for g, i, s in rows:
        best[g, i] = max(s, best.get((g, i), s))
    want = {(g, i) for g in (0, 1, 2, 3, 9) for i in [i for _, i in sorted((-s, i) for (h, i), s in best.items() if h == g)][:5]}
    got = topn.top_n(spark.createDataFrame(rows, "`group` BIGINT, id BIGINT, score DOUBLE").repartition(4)).collect()
    assert len(got) == 25 and {(r.group, r.id) for r in got} == want
    assert all(best[r.group, r.id] == r.score for r in got)


def test_top_n_limits_before_every_shuffle_by_group(spark):
    plan = topn._first(spark.range(9).selectExpr("id % 2 AS `group`", "id", "CAST(id AS DOUBLE) AS score"), 5)._jdf.queryExecution().executedPlan().toString()
    at = plan.index("Exchange hashpartitioning(group")
    assert "Partial" in plan[at:] and "WindowGroupLimit" in plan[at:]
