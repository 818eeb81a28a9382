"""Nearest-neighbour search: exact, filtered, batched, reranked, quantised and with inverted lists.

Every search sorts by (distance, id) ascending and reports the metric's score (see `metrics.score`). The ranking uses
the unrounded distance. A table is searched lazily; nothing is collected, except the IVF centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metrics as M
from ..functions.filters import Filter, compile_json, compile_typed, parse

OVERFETCH = 10


def predicate(df: DataFrame, f: Filter | dict | str | Column | None, metadata: str | None = None) -> Column:
    """A predicate as a column: a tree, its JSON, or a column (for example of a UDF on the id)."""
    if isinstance(f, Column):
        return f
    tree = f if isinstance(f, Filter) else parse(f)
    return compile_json(tree, F.col(metadata)) if metadata else compile_typed(tree, df.schema)


def knn(
    df: DataFrame,
    query: list[float] | Column,
    k: int = 10,
    metric: str | int = "cosine",
    id_col: str = "id",
    vector: str = "values",
    where: Filter | dict | str | Column | None = None,
    metadata: str | None = None,
    mode: str = "pre",
    include: list[str] | None = None,
) -> DataFrame:
    """The k nearest rows: id, score and the columns of `include`. A plan of one TakeOrderedAndProject.

    mode "pre" filters before the search (pushed into the scan); "overfetch" filters the 10 k nearest, so fewer than k
    rows may come out although more match. k of 0 or less is 10.
    """
    k = k if k > 0 else 10
    q = query if isinstance(query, Column) else M.vector_literal(query)
    dist = M.distance(metric)(F.col(vector), q)
    cond = predicate(df, where, metadata) if where is not None else None
    if cond is not None and mode == "pre":
        df = df.where(cond)
    rows = df.withColumn("_dist", dist).where(F.col(vector).isNotNull())
    if cond is not None and mode == "overfetch":
        rows = rows.orderBy("_dist", id_col).limit(OVERFETCH * k).where(cond)
    top = rows.orderBy("_dist", id_col).limit(k)
    return top.select(id_col, M.score(metric, F.col("_dist")).alias("score"), *(include or []))


def rerank(candidates: DataFrame, full: DataFrame, query: list[float], metric: str, id_col: str = "id", vector: str = "values") -> DataFrame:
    """Candidates scored again from the full vectors, sorted by (distance, id)."""
    joined = full.join(candidates.select(id_col), id_col, "left_semi")
    dist = M.distance(metric)(F.col(vector), M.vector_literal(query))
    return joined.withColumn("_dist", dist).orderBy("_dist", id_col).select(id_col, M.score(metric, F.col("_dist")).alias("score"))


def _pair_distance(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        return 1 - np.divide(q @ x.T, norm, out=np.zeros_like(norm), where=norm > 0)
    if metric == "dot":
        return -(q @ x.T)
    if metric == "euclidean":
        return ((q[:, None] - x[None]) ** 2).sum(2) if q.shape[0] * x.size < 4e6 else np.stack([((x - r) ** 2).sum(1) for r in q])
    if metric == "manhattan":
        return np.stack([np.abs(x - r).sum(1) for r in q])
    return np.stack([((x >= 0) != (r >= 0)).sum(1) for r in q]).astype(float)


def knn_batch(
    df: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vector: str = "values", query_block: int = 4096
) -> DataFrame:
    """query_id, rank, id, score: the k nearest rows of every query.

    `queries` (query_id, values) is a stated set of queries. The corpus is never shuffled or replicated: each task
    scores its Arrow batches against a block of queries by matrix products and keeps its k best per query, and
    a window over those few rows merges them. Queries are sent to the tasks in blocks of `query_block`.
    """
    metric = M.parse_metric(metric)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", kind), T.StructField("dist", T.DoubleType())]
    )
    corpus = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # one file is one partition: spread small inputs over the cores for the matrix products
    if corpus.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        corpus = corpus.repartition(spark.sparkContext.defaultParallelism)
    own = queries.where(F.col("values").isNotNull())
    blocks = max(1, -(-own.count() // query_block))
    out = None
    for block in range(blocks):
        mine = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", F.col("values").cast("array<double>")).toPandas()
        if not len(mine):
            continue
        sent = spark.sparkContext.broadcast((mine["query_id"].to_numpy(), [np.asarray(v, float) for v in mine["values"]]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best: dict = {}
            for pdf in batches:
                for dim, part in pdf.groupby(pdf["v"].map(len)):
                    rows = [i for i, v in enumerate(q) if len(v) == dim]
                    if not rows or not dim:
                        continue
                    x = np.stack([np.asarray(v, float) for v in part["v"]])
                    names = part["id"].to_numpy()
                    dist = _pair_distance(metric, np.stack([q[i] for i in rows]), x)
                    order = np.argsort(names, kind="stable")
                    for n, i in enumerate(rows):
                        d = dist[n][order]
                        cut = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                        keep = np.flatnonzero(d <= cut)
                        keep = keep[np.argsort(d[keep], kind="stable")[:k]]
                        got = best.get(i)
                        a, b = names[order[keep]], d[keep]
                        if got is not None:
                            a, b = np.concatenate([got[0], a]), np.concatenate([got[1], b])
                            s = np.lexsort((a, b))[:k]
                            a, b = a[s], b[s]
                        best[i] = (a, b)
            for i, (a, b) in best.items():
                yield pd.DataFrame({"query_id": np.repeat(ids[i], len(a)), "id": a, "dist": b})

        part = corpus.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    top = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "id", M.score(metric, F.col("dist")).alias("score"))


#: Corpus rows and queries of one task of `knn_join`.
GROUP_ROWS = 4096


def knn_join(df: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vector: str = "values", nprobe: int = 8) -> DataFrame:
    """query_id, rank, id, score: the k nearest other rows of every row.

    Rows lie in inverted lists of about GROUP_ROWS, and every row looks into the `nprobe` nearest lists, so the result is exact up
    to nprobe x GROUP_ROWS rows and work grows with the rows beyond that. A large list is cut into parts, its
    visitors into slices; a task holds one part and one slice. Only the lists' centres and counts reach the driver.
    """
    metric = M.parse_metric(metric)
    rows = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    lists = max(1, (n := rows.count()) // GROUP_ROWS)
    kind, v = df.schema[id_col].dataType, F.col(vector).cast("array<double>")
    if lists == 1:
        ivf, sizes = None, {0: n}
        base = rows.select(F.col(id_col).alias("id"), v.alias("v"), F.lit(0).alias("list_id"))
    else:
        ivf = InvertedLists(rows, lists, metric, id_col, vector)
        base = ivf.table.select(F.col(id_col).alias("id"), v.alias("v"), "list_id")
        sizes = {r.list_id: r["count"] for r in base.groupBy("list_id").count().collect()}
    most = max(1, -(-max(sizes.values(), default=1) // GROUP_ROWS))
    parts = F.create_map(*[x for i, n in sizes.items() for x in (F.lit(i), F.lit(max(1, -(-n // GROUP_ROWS))))])
    count = F.coalesce(parts[F.col("list_id")], F.lit(1))
    near = _probe_column(ivf.centres, metric, nprobe, "v") if ivf else F.array(F.lit(0))
    asked = base.select("id", "v", F.explode(near).alias("list_id"))
    asked = asked.where(F.col("list_id").isin(list(sizes)))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(most * min(lists, nprobe))))
    held = base.withColumn("part", F.pmod(F.xxhash64("id"), count).cast("int"))
    held = held.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(most * min(lists, nprobe) - 1).cast("bigint"))))
    group = ["list_id", "part", "slice"]
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("dist", T.DoubleType())])

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": a["id"][:0], "id": b["id"][:0], "dist": np.zeros(0)})]
        b = b.sort_values("id", kind="stable")
        for dim in sorted({len(v) for v in b["v"]} - {0}):
            p, q = b[b["v"].map(len) == dim], a[a["v"].map(len) == dim]
            x, names, own = np.stack(p["v"].to_numpy()) if len(p) else None, p["id"].to_numpy(), q["id"].to_numpy()
            for i in range(0, len(q), 512):
                dist = _pair_distance(metric, np.stack(q["v"].to_numpy()[i : i + 512]), x)
                dist[own[i : i + 512, None] == names[None]] = np.inf
                n = min(k, len(names))
                last = np.partition(dist, n - 1, axis=1)[:, n - 1 : n]
                r, c = np.nonzero((dist <= last) & np.isfinite(dist))
                out.append(pd.DataFrame({"query_id": own[i + r], "id": names[c], "dist": dist[r, c]}))
        return pd.concat(out)

    found = asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(search, schema)
    w = Window.partitionBy("query_id").orderBy("dist", "id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "id", M.score(metric, F.col("dist")).alias("score"))


def recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, recall: the share of true ids that were predicted; 0 without predictions."""
    t = truth.select("query_id", "id").distinct()
    p = predicted.select("query_id", "id", F.lit(1).alias("_hit")).distinct()
    return t.join(p, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def nearest_lists(centres: np.ndarray, metric: str, query: list[float], nprobe: int) -> list[int]:
    q = np.asarray(query, float)
    if metric == "cosine":
        q = q / max(np.linalg.norm(q), 1e-12)
    gap = -centres @ q if metric == "dot" else (centres**2).sum(1) / 2 - centres @ q
    return np.argsort(gap, kind="stable")[:nprobe].tolist()


def _probe_column(centres: np.ndarray, metric: str, nprobe: int, query: str) -> Column:
    return F.pandas_udf(lambda v: pd.Series([nearest_lists(centres, metric, e, nprobe) for e in v]), "array<int>")(query)


class InvertedLists:
    """IVF: rows are assigned to the nearest of `lists` centres; a search reads only the nearest lists.

    Centres are fitted by k-means with a fixed seed on at most `SAMPLE` rows; all rows are indexed. `write` stores
    the rows partitioned by list, so a search prunes partitions of files.
    """

    SAMPLE = 65_536

    def __init__(self, df: DataFrame, lists: int = 32, metric: str = "cosine", id_col: str = "id", vector: str = "values", seed: int = 0):
        self.metric, self.id_col, self.vector = M.parse_metric(metric), id_col, vector
        rows = df.where(F.col(vector).isNotNull())
        n = rows.count()
        share = 1.0 if n <= self.SAMPLE else self.SAMPLE / n
        sample = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < int(1_000_003 * share) + 1)
        t = sample.orderBy(id_col).select(F.col(vector).cast("array<double>").alias("v")).toArrow()["v"].combine_chunks()
        x = t.flatten().to_numpy().reshape(len(t), -1) if len(t) else np.zeros((0, 1))
        if self.metric == "cosine" and len(x):
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)] if len(x) else np.zeros((1, 1))
        for _ in range(12 if len(x) else 0):
            near = np.argmin((c**2).sum(1) / 2 - x @ c.T, 1)
            count = np.bincount(near, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        self.centres = c
        sent = df.sparkSession.sparkContext.broadcast(c)
        unit = self.metric == "cosine"

        @F.pandas_udf("int")
        def assign(v: pd.Series) -> pd.Series:
            c = sent.value
            x = np.stack([np.asarray(e, float) for e in v]) if len(v) else np.zeros((0, c.shape[1]))
            if unit:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            return pd.Series(np.argmin((c**2).sum(1) / 2 - x @ c.T, 1) if len(x) else [], dtype="int32")

        self.table = rows.withColumn("list_id", assign(vector))

    def write(self, path: str) -> None:
        self.table.write.mode("overwrite").partitionBy("list_id").parquet(path)
        self.table = self.table.sparkSession.read.parquet(path)

    def probe(self, query: list[float], nprobe: int) -> list[int]:
        return nearest_lists(self.centres, self.metric, query, nprobe)

    def search(self, query: list[float], k: int = 10, nprobe: int = 12, **options) -> DataFrame:
        lists = self.table.where(F.col("list_id").isin(self.probe(query, nprobe)))
        return knn(lists, query, k, self.metric, self.id_col, self.vector, **options)

    def search_batch(self, queries: DataFrame, k: int = 10, nprobe: int = 12) -> DataFrame:
        """query_id, rank, id, score for stated queries (query_id, values): each looks into its nearest lists only."""
        q = queries.where(F.col("values").isNotNull()).select("query_id", F.col("values").cast("array<double>").alias("q"))
        q = q.withColumn("list_id", F.explode(_probe_column(self.centres, self.metric, nprobe, "q")))
        pairs = self.table.select("list_id", F.col(self.id_col).alias("id"), F.col(self.vector).alias("v")).join(q, "list_id")
        pairs = pairs.select("query_id", "id", M.distance(self.metric)(F.col("v"), F.col("q")).alias("dist"))
        w = Window.partitionBy("query_id").orderBy("dist", "id")
        top = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return top.select("query_id", "rank", "id", M.score(self.metric, F.col("dist")).alias("score"))

    def search_adaptive(self, query: list[float], k: int = 10, spread: float = 0.5, nprobe: int = 2) -> DataFrame:
        """Doubles the number of lists until the k scores lie close together or all lists are read."""
        while True:
            found = self.search(query, k, nprobe)
            scores = [r.score for r in found.collect()]
            best = scores[0] if scores else 0.0
            wide = len(scores) < k or (best > 0 and (scores[-1] - best) / best > spread)
            if nprobe >= len(self.centres) or not wide:
                return found
            nprobe *= 2


def knn_quantized(df: DataFrame, query: list[float], k: int, codes_distance: Column, metric: str, id_col: str, vector: str, pool: int = OVERFETCH) -> DataFrame:
    """The k x pool nearest by a distance of codes, scored again exactly."""
    near = df.withColumn("_code", codes_distance).orderBy("_code", id_col).limit(pool * k)
    return knn(near, query, k, metric, id_col, vector)
