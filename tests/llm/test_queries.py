"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import pathlib

import duckdb
import pytest

from maskloom.llm.queries import QUERIES, SQL



def normal(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in pathlib.Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted("|".join(map(normal, r)) for r in df.select(*columns).collect())
    result = duck.execute(SQL[name])
    own = [d[0] for d in result.description]
    assert sorted(own) == columns
    at = [own.index(c) for c in columns]
    assert rows == sorted("|".join(normal(r[i]) for i in at) for r in result.fetchall())


def test_pieces_and_containers_agree(spark, sf):
    sizes = {r.doc_id: len(r.ids) for r in QUERIES["p7_ids"](spark, sf).collect()}
    found = {r.doc_id for r in QUERIES["p9_found"](spark, sf).collect()}
    pieces = QUERIES["p9_pieces"](spark, sf).collect()
    assert found == {d for d, n in sizes.items() if n > 512} == {r.doc_id for r in pieces} and len(found) > 0
    assert all(r.n_tokens <= 512 for r in pieces)
    fill = QUERIES["p8_fill"](spark, sf).first()
    assert fill.n_tokens == sum(sizes.values()) and fill.n_containers * 2048 == fill.n_tokens + fill.unused
    own = QUERIES["p8_deviation"](spark, sf).collect()
    assert sum(r.n_tokens for r in own) == fill.n_tokens and all(0 <= r.mean_away <= 1 for r in own)
    assert QUERIES["p8_mixture"](spark, sf).count() >= len(own)
