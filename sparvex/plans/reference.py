"""Queries of the vector engine's own operators, each over its whole tables, with their SQL.

The view V pairs embeddings with documents by number, to have metadata that may be absent. `scaled` multiplies each
vector by 1 + vec_id % 3, so that the metrics disagree on the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters as P
from ..functions import metrics as M
from ..functions import quantize as Z
from ..operators import search as S
from ..runtime import table

K = 10
STEP = 50  # the stated queries of a batch search: every id divisible by 50


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    by = (1 + F.col("vec_id") % 3).cast("double")
    return e.select("vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * by).alias("v"))


def view(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", "n_chars", "nb_format")
    tags = F.when(F.col("lang").isNotNull() & F.col("source").isNotNull(), F.array("lang", "source"))
    return scaled(spark, sf).join(d, "vec_id", "left").withColumn("tags", tags)


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector with id 0, unscaled: one row."""
    row = table(spark, sf, "embeddings").where(F.col("vec_id") == 0).select("embedding").first()
    return [float(x) for x in row[0]]


def stated(spark: SparkSession, sf: str) -> DataFrame:
    """The stated queries: query_id, values of every id divisible by STEP."""
    e = table(spark, sf, "embeddings").where(F.col("vec_id") % STEP == 0)
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("values"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6) + 0.0)


QUERIES, SQL = {}, {}

_S = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) AS v FROM embeddings"
_Q = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)"
_V = f"""SELECT s.*, d.lang, d.source, d.n_chars, d.nb_format, CASE WHEN d.lang IS NOT NULL AND d.source IS NOT NULL THEN [d.lang, d.source] END AS tags
  FROM ({_S}) s LEFT JOIN documents d ON d.doc_id = s.vec_id"""
_PAIR = "list_zip({a}, {b})"
_DIST = {
    "cosine": "(1 - list_cosine_similarity({a}, {b}))",
    "euclidean": f"list_sum(list_transform({_PAIR}, lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "dot": "(-list_inner_product({a}, {b}))",
    "manhattan": f"list_sum(list_transform({_PAIR}, lambda z: abs(z[1] - z[2])))",
    "hamming": f"len(list_filter({_PAIR}, lambda z: (z[1] >= 0) != (z[2] >= 0)))::DOUBLE",
}


def _dist(metric: str, a: str, b: str) -> str:
    return _DIST[metric].format(a=a, b=b)


def _sign(metric: str) -> str:
    return "-" if metric == "dot" else ""


def _knn_sql(metric: str, source: str = _S, where: str = "TRUE", outer: str = "TRUE", pool: int | None = None) -> str:
    inner = f"SELECT *, {_dist(metric, 'v', _Q)} AS dist FROM ({source}) WHERE {where} ORDER BY dist, vec_id LIMIT {pool or K}"
    return f"SELECT vec_id, round({_sign(metric)}dist, 6) + 0.0 AS score FROM ({inner}) WHERE {outer} ORDER BY dist, vec_id LIMIT {K}"


def _add_knn(name: str, metric: str) -> None:
    QUERIES[name] = lambda spark, sf: rounded(S.knn(scaled(spark, sf), first_vector(spark, sf), K, metric, "vec_id", "v"))
    SQL[name] = _knn_sql(metric)


for _name, _metric in (("cosine", "cosine"), ("l2sq", "euclidean"), ("dot", "dot"), ("l1", "manhattan"), ("hamming", "hamming")):
    _add_knn(f"knn_{_name}", _metric)


def _add_batch(name: str, metric: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = table(spark, sf, "embeddings")
        q = e.where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("values"))
        return rounded(S.knn_batch(scaled(spark, sf), q, K, metric, "vec_id", "v"))

    QUERIES[name] = run
    SQL[name] = f"""
WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id % {STEP} = 0),
d AS (SELECT query_id, vec_id AS id, {_dist(metric, "v", "w")} AS dist FROM ({_S}) CROSS JOIN q)
SELECT query_id, rank::INTEGER AS rank, id, round({_sign(metric)}dist, 6) + 0.0 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM d) WHERE rank <= {K}"""


for _name, _metric in (("knn_batch", "cosine"), ("knn_batch_l2", "euclidean"), ("knn_batch_dot", "dot"), ("knn_batch_l1", "manhattan")):
    _add_batch(_name, _metric)


def _column(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: scaled(spark, sf).select("vec_id", make(spark, sf).alias("x"))
    SQL[name] = f"SELECT vec_id, {sql} AS x FROM ({_S})"


_q = lambda spark, sf: M.vector_literal(first_vector(spark, sf))
_column("l2_distance", lambda s, d: F.round(M.euclidean(F.col("v"), _q(s, d)), 6), f"round(sqrt({_dist('euclidean', 'v', _Q)}), 6)")
_column("batch_cosine_similarity", lambda s, d: F.round(M.cosine_similarity(F.col("v"), _q(s, d)), 6), f"round(list_cosine_similarity(v, {_Q}), 6)")
_column("vector_norm", lambda s, d: F.round(M.magnitude(F.col("v")), 6), "round(sqrt(list_inner_product(v, v)), 6)")
_column("vector_normalize", lambda s, d: F.transform(M.normalize(F.col("v")), lambda x: F.round(x, 6) + 0.0), "list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6) + 0.0)")
_column("vector_dimension", lambda s, d: M.dimension(F.col("v")), "len(v)::INTEGER")

# Predicates: name -> (JSON, SQL over V). In the SQL an absent field is a null.
FILTERS: dict[str, tuple[dict, str]] = {
    "filter_eq": ({"label": 3}, "label = 3"),
    "filter_ne": ({"lang": {"$ne": "en"}}, "lang IS NULL OR lang <> 'en'"),
    "filter_gt": ({"n_chars": {"$gt": 1500}}, "n_chars > 1500"),
    "filter_gte": ({"n_chars": {"$gte": 1500}}, "n_chars >= 1500"),
    "filter_lt": ({"n_chars": {"$lt": 1500}}, "n_chars < 1500"),
    "filter_lte": ({"n_chars": {"$lte": 1500}}, "n_chars <= 1500"),
    "filter_gt_text": ({"lang": {"$gte": 0}}, "lang IS NOT NULL"),
    "filter_in": ({"lang": {"$in": ["fr", "de", 5]}}, "lang IN ('fr', 'de', '5')"),
    "filter_nin": ({"lang": {"$nin": ["fr", "de"]}}, "lang IS NULL OR lang NOT IN ('fr', 'de')"),
    "filter_contains": ({"source": {"$contains": "HUB/"}}, "contains(lower(source), 'hub/')"),
    "filter_startswith": ({"source": {"$startswith": "Delta"}}, "starts_with(lower(source), 'delta')"),
    "filter_endswith": ({"source": {"$endswith": "-3"}}, "ends_with(lower(source), '-3')"),
    "filter_all": ({"tags": {"$all": ["en", "nb-hub/starter-kit"]}}, "list_has_all(tags, ['en', 'nb-hub/starter-kit'])"),
    "filter_and": ({"$and": [{"label": {"$gte": 3}}, {"lang": "en"}]}, "label >= 3 AND lang = 'en'"),
    "filter_or": ({"$or": [{"label": 1}, {"lang": "fr"}]}, "label = 1 OR lang = 'fr'"),
    "filter_not": ({"$not": {"lang": "en"}}, "lang IS NULL OR lang <> 'en'"),
    "filter_nested": (
        {"$or": [{"$and": [{"label": {"$lt": 5}}, {"$not": {"nb_format": "ipynb"}}]}, {"n_chars": {"$gt": 4000, "$lte": 9000}}]},
        "(label < 5 AND (nb_format IS NULL OR nb_format <> 'ipynb')) OR (n_chars > 4000 AND n_chars <= 9000)",
    ),
    "filter_missing": ({"nothing": {"$ne": 1}, "lang": {"$eq": None}}, "lang IS NULL"),
    "filter_unknown_operator": ({"lang": {"$like": "en"}}, "FALSE"),
    "filter_empty": ({}, "TRUE"),
    "filter_null": (None, "TRUE"),
}


def _add_filter(name: str, f: dict, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = view(spark, sf)
        return v.where(P.compile_typed(P.parse(f), v.schema)).select("vec_id", "label", "lang")

    QUERIES[name] = run
    SQL[name] = f"SELECT vec_id, label, lang FROM ({_V}) WHERE {sql}"


for _name, (_f, _sql) in FILTERS.items():
    _add_filter(_name, _f, _sql)



def _builders(spark: SparkSession, sf: str) -> DataFrame:
    """A tree made by the builders instead of parsed."""
    v = view(spark, sf)
    tree = P.all_of(P.where("label", "$gte", 3), P.any_of(P.equal("lang", "en"), P.negate(P.where("n_chars", "$lt", 1500))))
    return v.where(P.compile_typed(tree, v.schema)).select("vec_id", "label", "lang")


QUERIES["filter_builders"] = _builders
SQL["filter_builders"] = f"SELECT vec_id, label, lang FROM ({_V}) WHERE label >= 3 AND (lang = 'en' OR n_chars >= 1500 OR n_chars IS NULL)"

_TYPE = "json_type(j, '$.{f}')"
_NUMBER = "json_type(j, '$.{f}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"
JSON_FILTERS: dict[str, tuple[dict, str]] = {
    "filter_json_eq": ({"category": "tech"}, "json_type(j, '$.category') = 'VARCHAR' AND j->>'$.category' = 'tech'"),
    "filter_json_number": ({"year": 2023}, f"({_NUMBER.format(f='year')} AND (j->>'$.year')::DOUBLE = 2023) OR (json_type(j, '$.year') = 'VARCHAR' AND j->>'$.year' = '2023')"),
    "filter_json_gte": ({"score": {"$gte": 50}}, f"{_NUMBER.format(f='score')} AND (j->>'$.score')::DOUBLE >= 50"),
    "filter_json_null": ({"category": None}, "j IS NULL OR json_type(j, '$.category') IS NULL OR json_type(j, '$.category') = 'NULL'"),
    "filter_json_contains": ({"title": {"$contains": "FJORD"}}, "json_type(j, '$.title') = 'VARCHAR' AND contains(lower(j->>'$.title'), 'fjord')"),
    "filter_json_all": ({"tags": {"$all": ["delta"]}}, "json_type(j, '$.tags') = 'ARRAY' AND json_contains(j->'$.tags', '\"delta\"')"),
    "filter_json_not": ({"$not": {"lang": "en"}}, "NOT coalesce(json_type(j, '$.lang') = 'VARCHAR' AND j->>'$.lang' = 'en', FALSE)"),
}


def _add_json(name: str, f: dict, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = table(spark, sf, "vectors")
        return v.where(P.compile_json(P.parse(f), F.col("metadata"))).select("coll_name", "id", "vec_version", "metadata")

    QUERIES[name] = run
    good = "CASE WHEN json_valid(metadata) THEN metadata::JSON END"
    SQL[name] = f"SELECT coll_name, id, vec_version, metadata FROM (SELECT *, {good} AS j FROM vectors) WHERE {sql}"


for _name, (_f, _sql) in JSON_FILTERS.items():
    _add_json(_name, _f, _sql)


def _props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.where(P.compile_json(P.parse({"k": {"$gte": 50}}), F.col("props"))).select("event_id", "props")


QUERIES["filter_json_props"] = _props
SQL["filter_json_props"] = "SELECT event_id, props FROM events WHERE (props::JSON->>'$.k')::DOUBLE >= 50"

_WANT = {"label": {"$lt": 5}, "lang": "en"}
for _mode in ("pre", "overfetch"):
    _name = {"pre": "knn_prefilter", "overfetch": "knn_overfetch"}[_mode]
    QUERIES[_name] = lambda spark, sf, mode=_mode: rounded(S.knn(view(spark, sf), first_vector(spark, sf), K, "euclidean", "vec_id", "v", _WANT, mode=mode))
SQL["knn_prefilter"] = _knn_sql("euclidean", _V, "label < 5 AND lang = 'en'")
SQL["knn_overfetch"] = _knn_sql("euclidean", _V, outer="label < 5 AND lang = 'en'", pool=10 * K)


def _id_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """Search with a caller's predicate on the id."""
    even = F.pandas_udf(lambda ids: ids % 2 == 0, "boolean")
    return rounded(S.knn(scaled(spark, sf), first_vector(spark, sf), K, "cosine", "vec_id", "v", even("vec_id")))


QUERIES["knn_id_predicate"] = _id_predicate
SQL["knn_id_predicate"] = _knn_sql("cosine", where="vec_id % 2 = 0")


def _rerank(spark: SparkSession, sf: str) -> DataFrame:
    v = scaled(spark, sf)
    near = S.knn(v, first_vector(spark, sf), 3 * K, "hamming", "vec_id", "v")
    return rounded(S.rerank(near, v, first_vector(spark, sf), "dot", "vec_id", "v"))


QUERIES["knn_rerank"] = _rerank
SQL["knn_rerank"] = f"""
WITH near AS (SELECT vec_id FROM ({_S}) ORDER BY {_dist("hamming", "v", _Q)}, vec_id LIMIT {3 * K})
SELECT vec_id, round(list_inner_product(v, {_Q}), 6) + 0.0 AS score FROM ({_S}) WHERE vec_id IN (SELECT vec_id FROM near)"""

# Quantisers
QUERIES["sq8_train"] = lambda spark, sf: Z.sq8_train(scaled(spark, sf), "v").select("pos", *(F.round(c, 6).alias(c) for c in ("low", "high", "scale")))
_TRAIN = f"""SELECT pos, min(x) AS low, max(x) AS high, CASE WHEN max(x) > min(x) THEN 255.0::DOUBLE / (max(x) - min(x)) ELSE 1.0 END AS scale
  FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS pos FROM ({_S})) GROUP BY pos"""
SQL["sq8_train"] = f"SELECT pos::INTEGER AS pos, round(low, 6) AS low, round(high, 6) AS high, round(scale, 6) AS scale FROM ({_TRAIN})"


def _sq8(spark: SparkSession, sf: str) -> DataFrame:
    v = scaled(spark, sf)
    model = Z.sq8_model(Z.sq8_train(v, "v"))  # one row
    return v.crossJoin(F.broadcast(model)).withColumn("codes", Z.sq8_encode(F.col("v"), F.col("lows"), F.col("highs"), F.col("scales")))


QUERIES["sq8_encode"] = lambda spark, sf: _sq8(spark, sf).select("vec_id", "codes")
_CODES = f"""SELECT vec_id, pos, low, scale, greatest(0, least(255, floor((x - low) * scale)))::SMALLINT AS code
  FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM ({_S})) JOIN ({_TRAIN}) USING (pos)"""
SQL["sq8_encode"] = f"SELECT vec_id, list(code ORDER BY pos) AS codes FROM ({_CODES}) GROUP BY vec_id"


def _sq8_distance(spark: SparkSession, sf: str) -> DataFrame:
    decoded = Z.sq8_decode(F.col("codes"), F.col("lows"), F.col("scales"))
    return _sq8(spark, sf).select("vec_id", F.round(M.squared_euclidean(decoded, _q(spark, sf)), 6).alias("x"))


QUERIES["sq8_distance"] = _sq8_distance
_DECODED = f"SELECT vec_id, list(code / scale + low ORDER BY pos) AS v FROM ({_CODES}) GROUP BY vec_id"
SQL["sq8_distance"] = f"SELECT vec_id, round({_dist('euclidean', 'v', _Q)}, 6) AS x FROM ({_DECODED})"
_column("sq8_untrained", lambda s, d: Z.sq8_encode(F.col("v")), "list_transform(v, lambda x: floor((least(greatest(x, -1), 1) + 1) * 127.5)::SMALLINT)")
_column(
    "binary_encode",
    lambda s, d: Z.binary_encode(F.col("v")),
    "list_transform(range((len(v) + 7) // 8), lambda b: list_sum(list_transform(range(8), lambda i: CASE WHEN v[b * 8 + i + 1] > 0 THEN 1 << i::INTEGER ELSE 0 END))::SMALLINT)",
)
_column("binary_decode", lambda s, d: Z.binary_decode(Z.binary_encode(F.col("v")), F.size("v")), "list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END::DOUBLE)")
_column(
    "binary_hamming",
    lambda s, d: Z.binary_distance(Z.binary_encode(F.col("v")), Z.binary_encode(_q(s, d))),
    f"len(list_filter(list_zip(v, {_Q}), lambda z: (z[1] > 0) != (z[2] > 0)))::INTEGER",
)


def _quantized(spark: SparkSession, sf: str) -> DataFrame:
    far = Z.binary_distance(Z.binary_encode(F.col("v")), Z.binary_encode(_q(spark, sf)))
    return rounded(S.knn_quantized(scaled(spark, sf), first_vector(spark, sf), K, far, "cosine", "vec_id", "v"))


QUERIES["knn_binary_rerank"] = _quantized
SQL["knn_binary_rerank"] = f"""
WITH near AS (SELECT * FROM ({_S}) ORDER BY len(list_filter(list_zip(v, {_Q}), lambda z: (z[1] > 0) != (z[2] > 0))), vec_id LIMIT {10 * K})
SELECT vec_id, round({_dist("cosine", "v", _Q)}, 6) + 0.0 AS score FROM near ORDER BY {_dist("cosine", "v", _Q)}, vec_id LIMIT {K}"""


def _recall_sq8(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the search over decoded 8-bit codes, of every stated query."""
    v = _sq8(spark, sf).select("vec_id", "v", Z.sq8_decode(F.col("codes"), F.col("lows"), F.col("scales")).alias("w"))
    q = stated(spark, sf)
    return S.recall(*(S.knn_batch(v, q, K, "euclidean", "vec_id", c) for c in ("w", "v")))


QUERIES["recall_sq8"] = _recall_sq8


def _top_sql(source: str) -> str:
    return f"""SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_dist("euclidean", "v", "w")}, vec_id) AS rank
  FROM ({source}) CROSS JOIN (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id % {STEP} = 0)) WHERE rank <= {K}"""


SQL["recall_sq8"] = f"""
WITH p AS ({_top_sql(_DECODED)}), t AS ({_top_sql(_S)})
SELECT query_id, count(p.vec_id)::DOUBLE / count(*) AS recall FROM t LEFT JOIN p USING (query_id, vec_id) GROUP BY query_id"""


def _pq(spark: SparkSession, sf: str) -> DataFrame:
    v = scaled(spark, sf)
    coded = Z.pq_encode(v, "v", Z.pq_train(v, "vec_id", "v", max(1, 64 // 8)))
    return coded.select("vec_id", "codes")


QUERIES["pq_encode"] = _pq


def _pq_error(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared error per element of decoding."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    book = Z.pq_train(v, "vec_id", "v", 8)
    d = Z.pq_decode(Z.pq_encode(v, "v", book), "codes", book)
    return d.agg(F.avg(M.squared_euclidean(F.col("v"), F.col("decoded")) / F.size("v")).alias("mse"))


QUERIES["pq_error"] = _pq_error
