"""Queries p3 and p5 to p9 over the domain tables and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskloom.llm import packing, sampling, splitting, terms, tokens, topn
from maskloom.shared import materialize, table

SEED = 17
CONTAINER = 2048
DIMENSIONS = {"rarity": ("image", "rarity"), "category_id": ("video_np_pair", "category_id")}


def _samples(spark: SparkSession, sf_dir: str) -> dict[str, sampling.StratifiedSample]:
    targets = table(spark, sf_dir, "sample_target")
    out = {}
    for name, (source, column) in DIMENSIONS.items():
        rows = table(spark, sf_dir, source).select("id", F.col(column).alias("stratum"))
        out[name] = sampling.StratifiedSample(rows, targets.where(F.col("dimension_name") == name), seed=SEED)
    return out


def _union(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("dimension_name"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union({n: s.report for n, s in _samples(spark, sf_dir).items()}).where("exhausted").select("dimension_name", "stratum")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union({n: s.report for n, s in _samples(spark, sf_dir).items()}).select("dimension_name", "stratum", "wanted", "available", "quota", "exhausted")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union({n: s.sample for n, s in _samples(spark, sf_dir).items()})


def _term_counts(spark: SparkSession, sf_dir: str) -> terms.TermCounts:
    """The backlog first, then the deliveries of the newest 30 days as an increment."""
    texts = F.transform("find_queries", lambda q: q["query_text"])
    rows = table(spark, sf_dir, "datapoint").select(F.col("datapoint_id").alias("id"), texts.alias("texts"), F.lit(False).alias("deleted"), "delivered_at")
    cut = rows.agg((F.max("delivered_at") - F.expr("INTERVAL 30 DAYS")).alias("cut")).first()["cut"]
    store = terms.TermCounts(spark)
    if cut is None:
        store.apply(rows)
        return store
    late = F.coalesce(F.col("delivered_at") >= F.lit(cut), F.lit(False))
    store.apply(rows.where(~late))
    store.apply(rows.where(late))
    return store


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(spark, sf_dir).marked().where("mark IS NOT NULL").select("term", "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(spark, sf_dir).marked()


def p5_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of images' phrases and categories' names, which are changed and deleted by later deliveries: the backlog and
    the two newest quarters as increments, the newest but one last."""
    out = None
    for name, column in (("image", "text_input"), ("category", "name")):
        rows = table(spark, sf_dir, name).select("id", F.array(column).alias("texts"), F.col("deleted_at").isNotNull().alias("deleted"), "delivered_at")
        newest = rows.agg(F.max("delivered_at")).first()[0]
        age = F.lit(0) if newest is None else F.coalesce(F.floor(F.datediff(F.lit(newest), F.col("delivered_at")) / 92), F.lit(9))
        store = terms.TermCounts(spark)
        for part in (age > 1, age == 0, age == 1):
            store.apply(rows.where(part))
        own = store.marked().select(F.lit(name).alias("table_name"), "term", "n_occurrences", "n_records", "mark")
        out = own if out is None else out.unionByName(own)
    return out


def _top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "prediction").select(F.col("image_id").alias("group"), "id", "score")
    best = topn.top_n(rows).withColumnRenamed("group", "image_id")
    known = table(spark, sf_dir, "image").select(F.col("id").alias("image_id"))
    return best.join(known, "image_id", "left_semi")  # after the limit: at most 5 rows an image are moved


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top5(spark, sf_dir).select("image_id", "id")


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top5(spark, sf_dir).select("image_id", "id", "score", "rank")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_ids(F.col("text")).alias("ids"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return p7_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens"), tokens.decoded(F.col("ids")).alias("text"))


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts from their ids alone."""
    return p7_decoded(spark, sf_dir).select("doc_id", "text")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each token, and the texts of slices of 16 tokens."""
    return p7_ids(spark, sf_dir).select("doc_id", tokens.token_spans(F.col("ids")).alias("spans"), tokens.decoded_slices(F.col("ids"), 16).alias("slices"))


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts from the slices, and their characters from the last token's span."""
    end = F.coalesce(F.try_element_at("spans", F.lit(-1))["last"], F.lit(0)).cast("long")
    return p7_spans(spark, sf_dir).select("doc_id", F.array_join("slices", "").alias("text"), end.alias("n_chars"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir), CONTAINER)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir), CONTAINER)


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document is placed once and whole, divided only if it must be, and no container is too full."""
    sized = materialize(_sized(spark, sf_dir), "sizes")
    return packing.shortfalls(sized, packing.pack(sized, CONTAINER), CONTAINER)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers filled with equal shares of all sources, while they last."""
    sized = _sized(spark, sf_dir)
    targets = table(spark, sf_dir, "documents").select("source").distinct().withColumn("share", F.lit(1.0))
    return packing.mixture(packing.pack(sized, CONTAINER, targets), targets)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's share of each container against its target."""
    return _mixed(spark, sf_dir)


def p8_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far containers are from the target proportions, by source."""
    return packing.deviation(_mixed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which more than one piece comes out."""
    return p9_pieces(spark, sf_dir).where("piece_no = 1").select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p9_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text again: its pieces without what they share, or the text itself if it has none."""
    own = p9_pieces(spark, sf_dir)
    before = F.coalesce(F.lag("end_byte").over(Window.partitionBy("doc_id").orderBy("piece_no")), F.lit(0))
    added = F.expr("decode(substring(encode(text, 'utf-8'), CAST(before - end_byte AS INT), CAST(end_byte - before AS INT)), 'utf-8')")
    parts = own.withColumn("before", before).select("doc_id", F.struct("piece_no", added.alias("added")).alias("p"))
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["added"]), "").alias("joined"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(whole, "doc_id", "left").select("doc_id", F.coalesce("joined", "text").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_report, p3_sample, p5_found, p5_counts, p5_revised, p6_found, p6_ranked, p7_ids, p7_decoded, p7_text, p7_spans, p7_restored,
        p8_containers, p8_fill, p8_whole, p8_mixture, p8_deviation, p9_found, p9_pieces, p9_joined,
    )
}

_STRATA = " UNION ALL ".join(
    f"SELECT '{name}' AS dimension_name, id, min({column}) AS stratum FROM {source} WHERE id IS NOT NULL GROUP BY id" for name, (source, column) in DIMENSIONS.items()
)
_QUOTAS = f"""WITH ids AS ({_STRATA}), sizes AS (SELECT dimension_name, count(*) // 10 AS m FROM ids GROUP BY 1),
  have AS (SELECT dimension_name, stratum, count(*) AS available FROM ids GROUP BY 1, 2),
  q AS (SELECT t.dimension_name, t.stratum, greatest((share_permille * m + 999) // 1000, min_rows) AS wanted, coalesce(available, 0) AS available
        FROM sample_target t JOIN sizes USING (dimension_name) LEFT JOIN have h ON h.dimension_name = t.dimension_name AND h.stratum = t.stratum)"""
_TERMS = r"""WITH last AS (SELECT datapoint_id, arg_max(find_queries, delivered_at) AS q FROM datapoint WHERE datapoint_id IS NOT NULL GROUP BY 1),
  t AS (SELECT datapoint_id, unnest(flatten(list_transform(q, lambda x: coalesce(regexp_extract_all(lower(x.query_text), '[\p{L}\p{N}]+'), [])))) AS term FROM last),
  c AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT datapoint_id) AS n_records FROM t GROUP BY term),
  m AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records * 5 > (SELECT count(*) FROM last) THEN 'common' END AS mark FROM c)"""
_REVISED = " UNION ALL ".join(
    rf"""SELECT '{t}' AS table_name, term, n_occurrences, n_records, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records * 5 > (SELECT count(*) FROM last_{t}) THEN 'common' END AS mark
  FROM (SELECT term, count(*) AS n_occurrences, count(DISTINCT id) AS n_records FROM (SELECT id, unnest(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')) AS term FROM last_{t}) GROUP BY term)"""
    for t, c in (("image", "text_input"), ("category", "name"))
)
_LAST = ", ".join(
    f"last_{t} AS (SELECT * FROM (SELECT * FROM {t} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY delivered_at DESC NULLS LAST, deleted_at IS NOT NULL DESC, {c} DESC NULLS LAST) = 1) WHERE deleted_at IS NULL)"
    for t, c in (("image", "text_input"), ("category", "name"))
)
_TOP = """WITH p AS (SELECT image_id, id, max(score + 0.0) AS score FROM prediction WHERE score IS NOT NULL AND NOT isnan(score) AND id IS NOT NULL AND image_id IN (SELECT id FROM image) GROUP BY 1, 2),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p)"""
SQL = {
    "p3_found": f"{_QUOTAS} SELECT dimension_name, stratum FROM q WHERE wanted > available",
    "p3_report": f"{_QUOTAS} SELECT dimension_name, stratum, wanted, available, least(wanted, available) AS quota, wanted > available AS exhausted FROM q",
    "p3_sample": f"""{_QUOTAS}, ranked AS (SELECT dimension_name, stratum, id, row_number() OVER (PARTITION BY dimension_name, stratum
        ORDER BY CAST('0x' || substr(md5('{SEED}:' || id), 1, 15) AS BIGINT), id) AS r FROM ids)
      SELECT dimension_name, stratum, id FROM ranked JOIN q USING (dimension_name, stratum) WHERE r <= wanted""",
    "p5_found": f"{_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p5_counts": f"{_TERMS} SELECT * FROM m",
    "p5_revised": f"WITH {_LAST} {_REVISED}",
    "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_restored": "SELECT doc_id, coalesce(text, '') AS text, coalesce(length(text), 0) AS n_chars FROM documents",
    "p8_whole": "SELECT 'items' AS kind, count(*) AS n FROM documents UNION ALL SELECT unnest(['missing', 'divided', 'over']), 0",
    "p9_joined": "SELECT doc_id, text FROM documents",
    "p6_found": f"{_TOP} SELECT image_id, id FROM r WHERE rank <= 5",
    "p6_ranked": f"{_TOP} SELECT image_id, id, score, rank FROM r WHERE rank <= 5",
}
