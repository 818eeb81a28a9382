import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparvex.functions import metrics as M
from sparvex.functions import quantize as Z
from sparvex.operators import graph as G
from sparvex.operators import search as S

COLS = "id string, values array<float>, label int"


def frame(spark, x, prefix="v"):
    return spark.createDataFrame([(f"{prefix}{i:04d}", [float(e) for e in v], i % 3) for i, v in enumerate(x)], COLS)


def test_metrics(spark):
    cases = [([1.0, 2.0], [3.0, -4.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), (None, [1.0]), ([0.0, -0.5], [0.0, 0.5])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<float>, b array<float>")
    f = {n: g(F.col("a"), F.col("b")).alias(n) for n, g in (("cos", M.cosine_similarity), ("l2", M.euclidean), ("sq", M.squared_euclidean), ("dot", M.dot), ("l1", M.manhattan), ("h", M.hamming))}
    r = df.select("i", *f.values()).orderBy("i").collect()
    assert math.isclose(r[0].cos, -5 / math.sqrt(125)) and math.isclose(r[0].l2, math.sqrt(40)) and r[0].sq == 40 and r[0].dot == -5 and r[0].l1 == 8 and r[0].h == 1
    assert r[1].cos == 0 and r[2].cos == 0 and r[2].l2 == M.MAX_FLOAT and r[3].dot == 0 and r[3].h == 1 and r[4].l1 == M.MAX_FLOAT and r[5].h == 1
    assert [M.parse_metric(x) for x in ("l2", "IP", "l1", "odd", None, 3)] == ["euclidean", "dot", "manhattan", "cosine", "cosine", "manhattan"]
    n = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(M.normalize(F.col("v")).alias("n")).collect()
    assert np.allclose(n[0].n, [0.6, 0.8]) and n[1].n == [0, 0]


def test_search_modes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df, q = frame(spark, x), x[5].tolist()
    for metric in M.METRICS:
        got = S.knn(df, q, 7, metric).collect()
        x32 = x.astype(np.float32).astype(float)
        want = S._pair_distance(metric, np.array([q]), x32)[0]
        order = np.lexsort((np.arange(300), want))[:7]
        assert [r.id for r in got] == [f"v{i:04d}" for i in order]
        scores = -want[order] if metric == "dot" else want[order]
        assert np.allclose([r.score for r in got], scores)
    pre = S.knn(df, q, 5, where={"label": 1}, include=["label"]).collect()
    assert len(pre) == 5 and {r.label for r in pre} == {1}
    assert len(S.knn(df.limit(300), q, 5, where={"label": 9}, mode="overfetch").collect()) == 0
    assert len(S.knn(df, q, 0).collect()) == 10 and S.knn(df.limit(0), q).count() == 0
    plan = S.knn(df, q)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_batch_ties_and_recall(spark):
    x = [[1.0, 0.0]] * 6 + [[0.0, 1.0], [1.0, 1.0]]
    df = frame(spark, x).unionByName(spark.createDataFrame([("null", None, 0), ("short", [1.0], 0)], COLS)).repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "query_id int, values array<double>")
    got = S.knn_batch(df, q, 3, query_block=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "v0000"), (1, "v0001"), (1, "v0002"), (2, "v0006"), (2, "v0007"), (2, "v0000")]
    truth = S.knn_batch(df, q, 3)
    assert {r.query_id: r.recall for r in S.recall(truth.where("rank < 3 and query_id = 1"), truth).collect()} == {1: 2 / 3, 2: 0.0}
    assert S.knn_batch(df, q.limit(0), 3).count() == 0


def test_inverted_lists(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    df = frame(spark, x)
    index = S.InvertedLists(df, 16)
    hits = 0
    for i in range(5):
        exact = {r.id for r in S.knn(df, x[i].tolist(), 10).collect()}
        hits += len(exact & {r.id for r in index.search(x[i].tolist(), 10, nprobe=8).collect()})
    assert hits / 50 >= 0.7
    assert {r.id for r in index.search(x[0].tolist(), 10, nprobe=16).collect()} == {r.id for r in S.knn(df, x[0].tolist(), 10).collect()}
    index.write(str(tmp_path / "ivf"))
    plan = index.search(x[0].tolist(), 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan.replace("isnotnull(", "")[:10_000] or "list_id" in plan
    assert index.search_adaptive(x[0].tolist(), 5).count() == 5


def test_rng_rule(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 4))
    edges = G.neighbour_graph(frame(spark, x), 4, 12, "euclidean")
    rows = edges.collect()
    degree = {}
    for r in rows:
        degree[r.src] = degree.get(r.src, 0) + 1
        assert r.src != r.dst
    assert set(degree.values()) == {4} and len(degree) == 80
    s = G.graph_stats(edges).first()
    assert (s["size"], s.total_connections) == (80, 320) and G.graph_data(edges, 3).count() == 3
    d = np.array([1.0, 1.1, 3.0])
    between = np.array([[0, 0.5, 9], [0.5, 0, 9], [9, 9, 0.0]])
    assert G.select_neighbours(d, between, 2) == [0, 2] and G.select_neighbours(d, between, 2, False) == [0, 1]


def test_quantizers(spark):
    x = [[(i + j) / 100 for j in range(64)] for i in range(100)]
    df = frame(spark, x)
    m = df.crossJoin(Z.sq8_model(Z.sq8_train(df, "values")))
    codes = Z.sq8_encode(F.col("values"), F.col("lows"), F.col("highs"), F.col("scales"))
    back = Z.sq8_decode(F.col("q"), F.col("lows"), F.col("scales"))
    r = m.withColumn("q", codes).select("q", "values", back.alias("d")).collect()
    assert max(np.mean((np.array(t.d) - np.array(t["values"])) ** 2) for t in r) <= 0.01 and max(max(t.q) for t in r) == 255
    ramp = spark.createDataFrame([([-1 + i / 64 for i in range(128)],), ([-9.0, 9.0],)], "v array<float>")
    r = ramp.select("v", Z.sq8_encode(F.col("v")).alias("q"), Z.sq8_decode(Z.sq8_encode(F.col("v"))).alias("d")).collect()
    assert np.mean((np.array(r[0].d) - np.array(r[0].v)) ** 2) <= 0.01 and r[1].q == [0, 255]
    pq = [[(i % 10) * 0.1 + (j % 10) * 0.01 for j in range(64)] for i in range(200)]
    df = frame(spark, pq)
    book = Z.pq_train(df, "id", "values", 8)
    r = Z.pq_decode(Z.pq_encode(df, "values", book), "codes", book).collect()
    assert all(len(t.codes) == 8 and np.mean((np.array(t.decoded) - np.array(t["values"])) ** 2) <= 0.5 for t in r)
    odd = frame(spark, np.random.default_rng(0).normal(size=(20, 13)))  # a late subspace begins beyond the end
    assert Z.pq_encode(odd, "values", Z.pq_train(odd, "id", "values", 6)).where(F.size("codes") > 0).count() == 20
    b = spark.createDataFrame([([1.0, -1.0] * 64, [-1.0, 1.0] * 64), ([0.0] * 9, [1.0] * 9)], "a array<float>, b array<float>")
    ea, eb = Z.binary_encode(F.col("a")), Z.binary_encode(F.col("b"))
    r = b.select(ea.alias("e"), Z.binary_distance(ea, eb).alias("d"), Z.binary_decode(ea, F.size("a")).alias("x"), "a").collect()
    assert len(r[0].e) == 16 and r[0].d == 128 and r[0].x == r[0].a and r[1].d == 9 and len(r[1].e) == 2
    assert [Z.quantizer_of(x) for x in ("SQ8", "product", "binary", "x", None)] == ["sq8", "pq", "binary", None, None]
    random.seed(0)
