from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskloom.llm import tokens


def test_spans_and_slices_of_all_documents(spark, sf):
    q = entry.queries()
    rows = q["p7_spans"](spark, sf).join(q["p7_decoded"](spark, sf), "doc_id").collect()
    assert len(rows) == q["p7_ids"](spark, sf).count()
    for r in rows:
        assert "".join(r.slices) == r.text and len(r.spans) == r.n_tokens and len(r.slices) == -(-r.n_tokens // 16)
        assert not r.spans or (r.spans[0].first == 0 and r.spans[-1].last == len(r.text))


def test_a_split_character_is_whole(spark):
    df = spark.createDataFrame([(1, "a👍𓀀é𐍈" * 9), (2, ""), (3, None)], "id INT, t STRING")
    ids = df.select("id", "t", tokens.token_ids(F.col("t")).alias("ids"))
    out = {r.id: r for r in ids.select("id", "t", tokens.decoded_slices(F.col("ids"), 1).alias("s"), F.transform("ids", lambda i: i).alias("ids")).collect()}
    assert "".join(out[1].s) == out[1].t and "" in out[1].s and "�" not in "".join(out[1].s)
    assert out[2].s == [] and out[3].s == []
