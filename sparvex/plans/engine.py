"""Queries that go through the engine's own objects (store, collection, catalog, index, stream, REST adapter), with their SQL.

Each works in a folder of its own under the checkpoint folder; its result is checkpointed and the folder removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api.server import handle
from ..functions import metrics as M
from ..functions import quantize as Z
from ..operators import graph as G
from ..operators import search as S
from ..runtime import checkpoint_dir, cut, table
from ..sources import catalog as C
from ..sources.store import Files, Store, decoded, encoded
from ..streaming.upserts import apply_changes
from .reference import _DIST, STEP, K, _dist, _knn_sql, first_vector, rounded, scaled, stated

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    """Register a query that gets (spark, sf, folder)."""

    def add(run: Callable[[SparkSession, str, str], DataFrame]):
        def query(spark: SparkSession, sf: str) -> DataFrame:
            folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
            try:
                return cut(run(spark, sf, folder))
            finally:
                Files(spark).remove(folder)

        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return run

    return add


# The store over the change log of `events`: the user is the id, "purchase" a delete, (ts, event_id) the order.
_LOG = "SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events"
_LIVE = "SELECT user_id, event_id, value FROM (" + _LOG + ") WHERE rn = 1 AND event_type <> 'purchase'"


def _changes(spark: SparkSession, sf: str, deletes: bool) -> DataFrame:
    e = table(spark, sf, "events")
    op = F.when((F.col("event_type") == "purchase") & F.lit(deletes), 1).otherwise(0)
    return e.select(
        F.col("user_id").cast("string").alias("id"), op.alias("op"), F.array("value").alias("values"), F.to_json(F.struct("event_id", "value")).alias("metadata"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.col("event_id").alias("row"),
    )


def _filled(spark: SparkSession, sf: str, folder: str, deletes: bool) -> Store:
    """The log in two batches of which neither is older as a whole."""
    store, rows = Store(spark, folder), _changes(spark, sf, deletes)
    for half in (1, 0):
        store.append(rows.where(F.col("row") % 2 == half), order="time")
    return store


def _told(rows: DataFrame) -> DataFrame:
    m = F.from_json("metadata", "event_id bigint, value double")
    return rows.select(F.col("id").cast("bigint").alias("user_id"), m["event_id"].alias("event_id"), m["value"].alias("value"))


@_query("upsert_latest", f"SELECT user_id, event_id, value FROM ({_LOG}) WHERE rn = 1")
def _upsert(spark, sf, folder):
    return _told(_filled(spark, sf, folder, False).current())


@_query("delete_tombstone", _LIVE)
def _delete(spark, sf, folder):
    return _told(_filled(spark, sf, folder, True).current())


@_query("compact_count", f"SELECT count(*) AS live, 0 AS batches FROM ({_LIVE})")
def _compact(spark, sf, folder):
    store = _filled(spark, sf, folder, True)
    store.compact()
    return spark.createDataFrame([(store.size(), len(store.manifest["batches"]))], "live bigint, batches int")


@_query("compact_late", _LIVE)
def _compact_late(spark, sf, folder):
    """Compaction between the batches: older changes that come after it do not bring deleted rows back."""
    store, rows = Store(spark, folder), _changes(spark, sf, True)
    for half in (1, 0):
        store.append(rows.where(F.col("row") % 2 == half), order="time")
        store.compact()
    return _told(store.current())


@_query("store_recover", _LIVE)
def _recover(spark, sf, folder):
    _filled(spark, sf, folder, True).close()
    store = Store(spark, folder)
    store.sync()
    kinds = "id string, metadata string"
    return _told(spark.createDataFrame([(r.id, r.metadata) for r in store.iterate()], kinds))


@_query("store_truncate", "SELECT 0::BIGINT AS live")
def _truncate(spark, sf, folder):
    store = _filled(spark, sf, folder, True)
    store.truncate()
    return spark.createDataFrame([(store.size(),)], "live bigint")


@_query("stream_upserts", _LIVE)
def _stream(spark, sf, folder):
    """The log as a stream, in micro-batches of files of no order in time."""
    _changes(spark, sf, True).repartition(3, "row").write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")
    kind = spark.read.parquet(f"{folder}/in").schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    apply_changes(stream, store, f"{folder}/state", "time").awaitTermination()
    return _told(store.current())


# Collections over the embeddings
_E = "SELECT vec_id, vec_id::VARCHAR AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


def _rows(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    e = table(spark, sf, "embeddings").where(where)
    return e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), F.to_json(F.struct("label", (F.col("vec_id") % 2 == 0).alias("even"))).alias("metadata"))


def _collection(spark: SparkSession, sf: str, folder: str, *options, metric: str = "euclidean") -> C.Collection:
    c = C.Catalog(spark, folder).create("c", 64, C.with_metric(metric), *options)
    c.insert(_rows(spark, sf))
    return c


@_query("get_by_id", "SELECT '7' AS id, label, 1::BIGINT AS version FROM embeddings WHERE vec_id = 7")
def _get(spark, sf, folder):
    row = _collection(spark, sf, folder).get("7")
    return spark.createDataFrame([(row.id, json.loads(row.metadata)["label"], row.version)], "id string, label int, version bigint")


@_query("update_version", "SELECT vec_id::VARCHAR AS id, CASE vec_id WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 1 END::BIGINT AS version, CASE vec_id WHEN 3 THEN -1 WHEN 4 THEN -4 ELSE label END AS label FROM embeddings")
def _update(spark, sf, folder):
    c = _collection(spark, sf, folder)
    c.update("3", metadata={"label": -3})
    c.update("3", [0.0] * 64, {"label": -1})
    c.update("4", metadata={"label": -4})
    return c.current().select("id", "version", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@_query("collection_delete", "SELECT count(*) FILTER (vec_id % 3 <> 0) AS live FROM embeddings")
def _collection_delete(spark, sf, folder):
    db = C.Catalog(spark, folder)
    db.create("c", 64)
    db.insert("c", _rows(spark, sf))
    db.delete_vector("c", _rows(spark, sf, "vec_id % 3 = 0").select("id"))
    db.delete_vector("c", "unknown")
    return spark.createDataFrame([(db.get("c").count(),)], "live bigint")


@_query("insert_refused", "SELECT count(*) AS live, TRUE AS refused FROM embeddings")
def _refused(spark, sf, folder):
    """A batch with one wrong row is refused whole."""
    c, refused = _collection(spark, sf, folder), False
    bad = _rows(spark, sf).withColumn("values", F.when(F.col("id") == "5", F.array(F.lit(1.0).cast("float"))).otherwise(F.col("values"))).withColumn("id", F.concat(F.lit("n"), "id"))
    try:
        c.insert(bad)
    except ValueError:
        refused = True
    return spark.createDataFrame([(c.count(), refused)], "live bigint, refused boolean")


def _stats_rows(spark: SparkSession, stats: list[dict]) -> DataFrame:
    rows = [(s["name"], s["dimension"], s["count"], s["metric"], s["index_type"], *(s["index"][k] for k in ("size", "max_layer", "entry_point", "m", "ef_construction", "use_heuristic"))) for s in stats]
    return spark.createDataFrame(rows, "name string, dimension int, count bigint, metric string, index_type string, size bigint, max_layer int, entry_point string, m int, ef_construction int, use_heuristic boolean")


_LEVEL = "least(16, floor(ln((('0x' || substr(md5({id}), 1, 8))::BIGINT + 1) / 4294967296.0) / ln(0.36067376022224085)))::INTEGER"


@_query("collection_stats", f"""
WITH e AS (SELECT vec_id::VARCHAR AS id, CASE vec_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS name FROM embeddings),
l AS (SELECT *, {_LEVEL.format(id='id')} AS level FROM e)
SELECT name, 64 AS dimension, count(*) AS "count", CASE name WHEN 'a' THEN 'euclidean' WHEN 'b' THEN 'dot' ELSE 'cosine' END AS metric, 'hnsw' AS index_type,
  count(*) AS size, max(level) AS max_layer, arg_min(id, (-level, id)) AS entry_point, CASE name WHEN 'a' THEN 8 ELSE 16 END AS m, CASE name WHEN 'a' THEN 50 ELSE 200 END AS ef_construction, TRUE AS use_heuristic
FROM l GROUP BY name""")  # fmt: skip
def _stats(spark, sf, folder):
    db = C.Catalog(spark, folder)
    options = {"a": [C.with_metric("l2"), C.with_graph_params(8, 50)], "b": [C.with_metric("ip")], "c": [C.with_metric("unheard of")]}
    for i, (name, own) in enumerate(options.items()):
        db.create(name, 64, *own).insert(_rows(spark, sf, f"vec_id % 3 = {i}"))
    return _stats_rows(spark, [db.get(n).stats() for n in db.list()])


@_query("catalog_reopen", """SELECT * FROM (VALUES ('first', 3, 1, 16, 200, 'sq8', 2::BIGINT), ('third', 5, 3, 8, 50, '', 0::BIGINT)) t(name, dimension, metric, m, ef_construction, quantization, "count")""")
def _reopen(spark, sf, folder):
    db = C.Catalog(spark, folder)
    db.create("first", 3, C.with_metric("euclidean"), C.with_quantization("sq8")).insert([{"id": "x", "values": [1, 2, 3]}, {"id": "y", "values": [0, 0, 0]}])
    db.create("second", 4)
    db.create("third", 5, C.with_metric("l1"), C.with_graph_params(8, 50))
    db.delete("second")
    db.close()
    db = C.Catalog(spark, folder)
    rows = [(c.name, c.dimension, c.config.metric, c.config.m, c.config.ef_construction, c.config.quantization, c.count()) for c in map(db.get, db.list())]
    return spark.createDataFrame(rows, "name string, dimension int, metric int, m int, ef_construction int, quantization string, count bigint")


@_query("catalog_errors", """SELECT * FROM (VALUES ('again', 'Exists'), ('nameless', 'ValueError'), ('outside', 'ValueError'), ('flat', 'ValueError'), ('get', 'NotFound'), ('drop', 'NotFound'), ('vector', 'NotFound'), ('update', 'NotFound'), ('query', 'ValueError'), ('version', '0.1.0')) t(step, said)""")
def _errors(spark, sf, folder):
    db = C.Catalog(spark, folder)
    c = db.create("c", 2)
    steps = {
        "again": lambda: db.create("c", 2), "nameless": lambda: db.create("", 2), "outside": lambda: db.create("../c", 2), "flat": lambda: db.create("d", 0), "get": lambda: db.get("d"),
        "drop": lambda: db.delete("d"), "vector": lambda: db.get_vector("c", "x"), "update": lambda: c.update("x", [1.0, 2.0]), "query": lambda: c.search([1.0]),
    }
    rows = []
    for name, step in steps.items():
        try:
            step()
        except (ValueError, KeyError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame([*rows, ("version", db.version())], "step string, said string")


_Q = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)"


def _found_sql(metric: str, where: str = "TRUE", outer: str = "TRUE", pool: int | None = None) -> str:
    """The search over the collection's rows, whose ids are texts."""
    named = _knn_sql(metric, "@ROWS", "@WHERE", outer, pool).replace(_Q, "@Q").replace("vec_id", "id")
    return named.replace("@ROWS", _E).replace("@WHERE", where).replace("@Q", _Q)


@_query("collection_search", _found_sql("cosine"))
def _search(spark, sf, folder):
    return rounded(_collection(spark, sf, folder, metric="cosine").search(first_vector(spark, sf), K, include=()))


@_query("collection_filtered", _found_sql("manhattan", "label >= 3 AND vec_id % 2 = 0"))
def _filtered(spark, sf, folder):
    c = _collection(spark, sf, folder, metric="l1")
    return rounded(c.search(first_vector(spark, sf), K, {"label": {"$gte": 3}, "even": True}, include=()))


@_query("db_search", _found_sql("euclidean", outer="label < 5", pool=10 * K))
def _db_search(spark, sf, folder):
    """The over-fetch mode, through the catalog."""
    _collection(spark, sf, folder)
    return rounded(C.Catalog(spark, folder).get("c").search(first_vector(spark, sf), K, {"label": {"$lt": 5}}, mode="overfetch", include=()))


@_query("search_rerank", f"SELECT id, round(-list_inner_product(v, {_Q}), 6) + 0.0 AS score FROM ({_E}) ORDER BY -list_inner_product(v, {_Q}), id LIMIT {K}")
def _reranked(spark, sf, folder):
    """Reranked scores of the dot metric are distances."""
    return rounded(_collection(spark, sf, folder, metric="dot").search(first_vector(spark, sf), K, rerank=True, include=()))


@_query("collection_batch", f"""
WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id % {STEP} = 0)
SELECT query_id, rank::INTEGER AS rank, id, round(dist, 6) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM (SELECT query_id, id, {_dist("cosine", "v", "w")} AS dist FROM ({_E}) CROSS JOIN q)) WHERE rank <= {K}""")
def _batch(spark, sf, folder):
    return rounded(_collection(spark, sf, folder, metric="cosine").search_batch(stated(spark, sf), K))


@_query("search_quantized_binary", f"""
WITH near AS (SELECT * FROM ({_E}) ORDER BY len(list_filter(list_zip(v, {_Q}), lambda z: (z[1] > 0) != (z[2] > 0))), id LIMIT 200)
SELECT id, round({_dist("euclidean", "v", _Q)}, 6) + 0.0 AS score FROM near ORDER BY {_dist("euclidean", "v", _Q)}, id LIMIT {K}""")
def _binary(spark, sf, folder):
    return rounded(_collection(spark, sf, folder, C.with_quantization("binary")).search(first_vector(spark, sf), K, ef=200, quantized=True, include=()))


def _recall_ok(spark: SparkSession, found: DataFrame, truth: DataFrame) -> DataFrame:
    return S.recall(found, truth).agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("good"))


_GOOD = f"SELECT count(*) AS queries, TRUE AS good FROM embeddings WHERE vec_id % {STEP} = 0"


def _truth(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    return S.knn_batch(scaled(spark, sf), stated(spark, sf), K, metric, "vec_id", "v")


@_query("recall_ivf", _GOOD)
def _recall_ivf(spark, sf, folder):
    """Inverted lists, written by list: recall of the stated queries against the exact search is 0.9 or more."""
    lists = S.InvertedLists(scaled(spark, sf), 32, "cosine", "vec_id", "v")
    lists.write(f"{folder}/lists")
    return _recall_ok(spark, lists.search_batch(stated(spark, sf), K, 24), _truth(spark, sf, "cosine"))


@_query("recall_binary", _GOOD)
def _recall_binary(spark, sf, folder):
    """Binary codes with reranking of the nearest 400."""
    v, q = scaled(spark, sf), stated(spark, sf)
    signs = v.withColumn("signs", F.transform("v", lambda x: F.when(x > 0, 1.0).otherwise(-1.0)))
    near = S.knn_batch(signs, q, 400, "hamming", "vec_id", "signs").select("query_id", "id")
    pairs = near.join(v.select(F.col("vec_id").alias("id"), "v"), "id").join(q, "query_id")
    top = pairs.select("query_id", "id", M.cosine_distance(F.col("v"), F.col("values")).alias("d")).groupBy("query_id")
    top = top.agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, K).alias("l")).select("query_id", F.inline("l"))
    return _recall_ok(spark, top, _truth(spark, sf, "cosine"))


@_query("ivf_knn", _knn_sql("cosine"))
def _ivf(spark, sf, folder):
    """All lists probed: exact. The lists lie in folders of their own, of which a search reads those it probes."""
    lists = S.InvertedLists(scaled(spark, sf), 32, "cosine", "vec_id", "v")
    lists.write(f"{folder}/lists")
    return rounded(lists.search(first_vector(spark, sf), K, 32))


@_query("knn_adaptive", f"SELECT {K}::BIGINT AS n, TRUE AS sorted, TRUE AS own")
def _adaptive(spark, sf, folder):
    lists = S.InvertedLists(scaled(spark, sf), 32, "euclidean", "vec_id", "v")
    lists.write(f"{folder}/lists")
    found = lists.search_adaptive(first_vector(spark, sf), K).collect()
    return spark.createDataFrame([(len(found), [r.score for r in found] == sorted(r.score for r in found), found[0].vec_id == 0)], "n bigint, sorted boolean, own boolean")


@_query("export_import", "SELECT vec_id::VARCHAR AS id, label, len(embedding)::INTEGER AS dim, embedding AS values FROM embeddings")
def _export(spark, sf, folder):
    c = _collection(spark, sf, f"{folder}/a")
    c.export(f"{folder}/out")
    other = C.Catalog(spark, f"{folder}/b").create("d", 64)
    other.import_(f"{folder}/out")
    return other.current().select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"), F.size("values").alias("dim"), "values")


@_query("binary_codec", "SELECT vec_id::VARCHAR AS id, embedding AS values FROM embeddings")
def _codec(spark, sf, folder):
    return decoded(encoded(_rows(spark, sf)))


_NAMES = ["cosine", "l2", "euclidean", "dot", "ip", "l1", "manhattan", "hamming", "L2", "nothing", ""]


@_query("metric_names", "SELECT * FROM (VALUES ('cosine','cosine'),('l2','euclidean'),('euclidean','euclidean'),('dot','dot'),('ip','dot'),('l1','manhattan'),('manhattan','manhattan'),('hamming','hamming'),('L2','euclidean'),('nothing','cosine'),('','cosine')) t(name, metric)")
def _names(spark, sf, folder):
    return spark.createDataFrame([(n, M.parse_metric(n)) for n in _NAMES], "name string, metric string")


@_query("quantizer_names", "SELECT * FROM (VALUES ('scalar','sq8'),('sq8','sq8'),('pq','pq'),('product','pq'),('binary','binary'),('none',''),('','')) t(name, kind)")
def _kinds(spark, sf, folder):
    return spark.createDataFrame([(n, Z.quantizer_of(n) or "") for n in ("scalar", "sq8", "pq", "product", "binary", "none", "")], "name string, kind string")


# The neighbour graph. SQL states the rule by a fold over each vector's candidates.
_M, _CANDIDATES = 16, 32
_S64 = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) AS v FROM embeddings"
_EDGES = f"""
WITH s AS ({_S64}), d AS (
  SELECT a.vec_id AS src, b.vec_id AS dst, {_DIST["cosine"].format(a="a.v", b="b.v")} AS dist, b.v FROM s a JOIN s b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= {_CANDIDATES}),
l AS (SELECT src, list({{'dst': dst, 'dist': dist, 'v': v}} ORDER BY dist, dst) AS c FROM d GROUP BY src),
t AS (SELECT src, c, list_reduce(list_transform(c, lambda x: [x]), lambda a, b: CASE
    WHEN len(a) < {_M} AND len(list_filter(a, lambda s: (1 - list_cosine_similarity(s.v, b[1].v)) < b[1].dist)) = 0 THEN a || b ELSE a END) AS taken FROM l),
f AS (SELECT src, taken || list_filter(c, lambda x: NOT list_contains(list_transform(taken, lambda y: y.dst), x.dst))[1:{_M} - len(taken)] AS links FROM t),
edges AS (SELECT src, unnest(list_transform(links, lambda x: {{'dst': x.dst, 'dist': x.dist}}), recursive := true) FROM f)"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbour_graph(scaled(spark, sf), _M, _CANDIDATES, "cosine", "vec_id", "v")


@_query("rng_graph", _EDGES + " SELECT src, dst, round(dist, 6) + 0.0 AS dist FROM edges")
def _graph(spark, sf, folder):
    return _edges(spark, sf).withColumn("dist", F.round("dist", 6) + 0.0)


@_query("graph_stats", _EDGES + """, g AS (SELECT src, count(*) AS degree FROM edges GROUP BY src)
SELECT count(*) AS size, sum(degree)::BIGINT AS total_connections, min(degree) AS min_degree, max(degree) AS max_degree, avg(degree) AS mean_degree FROM g""")
def _graph_stats(spark, sf, folder):
    return G.graph_stats(_edges(spark, sf))


@_query("graph_data", _EDGES + f" SELECT src AS id, {_LEVEL.format(id='src::VARCHAR')} AS layer, list(dst ORDER BY dist, dst) AS links FROM edges GROUP BY src")
def _graph_data(spark, sf, folder):
    return G.graph_data(_edges(spark, sf), 0, scaled(spark, sf), "vec_id")


@_query("graph_links", "SELECT count(*) AS linked, TRUE AS bounded, TRUE AS both_ways FROM embeddings")
def _graph_links(spark, sf, folder):
    """Links go both ways, at most 2 m a vector; every vector has one in layer 0."""
    v = scaled(spark, sf).select(F.col("vec_id").alias("id"), "v")
    one = cut(_edges(spark, sf))
    links = cut(G.linked_back(one, v, 2 * _M, "cosine"))
    degree = links.groupBy("src").count().agg(F.count(F.lit(1)), F.max("count")).first()
    back = one.join(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").count()
    return spark.createDataFrame([(degree[0], degree[1] <= 2 * _M, back >= 0.9 * one.count())], "linked bigint, bounded boolean, both_ways boolean")


@_query("graph_entry", f"""SELECT count(*) AS size, max({_LEVEL.format(id='vec_id::VARCHAR')}) AS max_layer, arg_min(vec_id, (-{_LEVEL.format(id='vec_id::VARCHAR')}, vec_id)) AS entry_point FROM embeddings""")
def _entry(spark, sf, folder):
    return G.entry_point(scaled(spark, sf), "vec_id")


@_query("pq_distance", "SELECT vec_id, TRUE AS equal FROM embeddings")
def _pq_distance(spark, sf, folder):
    """Distances by tables are those of the decoded vectors."""
    v, q = scaled(spark, sf), first_vector(spark, sf)
    book = cut(Z.pq_train(v, "vec_id", "v", 8))
    coded = Z.pq_decode(Z.pq_encode(v, "v", book), "codes", book)
    gap = F.abs(Z.pq_distance(F.col("codes"), q, book) - M.squared_euclidean(F.col("decoded"), M.vector_literal(q)))
    return coded.select("vec_id", (gap < 1e-9).alias("equal"))


_CALLS = [
    ("health", "GET", "/health", None), ("version", "GET", "/version", None), ("create", "POST", "/collections", {"name": "c", "dimension": 2, "metric": "euclidean"}),
    ("create again", "POST", "/collections", {"name": "c", "dimension": 2}), ("create flat", "POST", "/collections", {"name": "d", "dimension": 0}), ("list", "GET", "/collections", None),
    ("insert", "POST", "/collections/c/vectors", {"vectors": [{"id": "a", "values": [0, 0], "metadata": {"k": 1}}, {"id": "b", "values": [3, 4], "metadata": {"k": 2}}, {"id": "e", "values": [1, 0]}]}),
    ("insert nothing", "POST", "/collections/c/vectors", {"vectors": []}), ("get", "GET", "/collections/c/vectors?id=b", None), ("get none", "GET", "/collections/c/vectors?id=x", None),
    ("search", "POST", "/collections/c/search", {"vector": [0, 0], "k": 2}), ("search where", "POST", "/collections/c/search", {"vector": [0, 0], "filter": {"k": {"$gte": 2}}}),
    ("search empty", "POST", "/collections/c/search", {"vector": []}), ("graph", "GET", "/collections/c/graph", None), ("delete vector", "DELETE", "/collections/c/vectors?id=a", None),
    ("stats", "GET", "/collections/c", None), ("method", "PUT", "/collections", None), ("options", "OPTIONS", "/collections", None), ("drop", "DELETE", "/collections/c", None), ("drop again", "DELETE", "/collections/c", None),
]
_SAID = """('health', 200, 'healthy'), ('version', 200, '0.1.0'), ('create', 201, 'c 2'), ('create again', 409, ''), ('create flat', 400, ''), ('list', 200, 'c'), ('insert', 201, '3'), ('insert nothing', 400, ''),
('get', 200, 'b 3.0,4.0 2'), ('get none', 404, ''), ('search', 200, 'a 0.0,e 1.0'), ('search where', 200, 'b 25.0'), ('search empty', 400, ''), ('graph', 200, 'a:e,b;b:e,a;e:a,b'), ('delete vector', 200, 'deleted'),
('stats', 200, '2 euclidean'), ('method', 405, ''), ('options', 204, ''), ('drop', 200, 'deleted'), ('drop again', 404, '')"""


def _said(a: dict | None) -> str:
    if not a or "error" in a:
        return ""
    for key, form in (
        ("results", lambda x: ",".join(f"{r['id']} {r['score']}" for r in x)), ("nodes", lambda x: ";".join(f"{n['id']}:{','.join(n['connections'])}" for n in x)), ("collections", ",".join),
        ("values", lambda x: f"{a['id']} {','.join(map(str, x))} {a['metadata']['k']}"), ("count", lambda x: f"{x} {a['metric']}"), ("name", lambda x: f"{x} {a['dimension']}"),
    ):
        if key in a:
            return form(a[key])
    return str(next(iter(a.values())))


@_query("rest_contract", f"SELECT * FROM (VALUES {_SAID}) t(step, status, said)")
def _rest(spark, sf, folder):
    db, rows = C.Catalog(spark, folder), []
    for step, method, url, body in _CALLS:
        status, answer = handle(db, method, url, json.dumps(body).encode() if body is not None else b"")
        rows.append((step, status, _said(answer)))
    return spark.createDataFrame(rows, "step string, status int, said string")
