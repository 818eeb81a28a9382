"""A layered neighbour graph with relative-neighbourhood selection, as an edges table.

A vector is in the layers 0 to its level; levels are geometric and drawn from a hash of the id, so they are repeatable. In
every layer a vector is linked to at most m of its nearest candidates (`select_neighbours`), links go both ways, and
a vector with more than 2 m links keeps those that the same rule selects. Candidates come from inverted lists
(`search.knn_join`); a vector's links and candidates are the only rows that ever meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from .search import _pair_distance, knn_join

#: The chance of one more level, 1 / ln 16, and the highest level.
CHANCE, MOST_LEVEL = 0.36067376022224085, 16


def level_of(id: Column) -> Column:
    """The level of an id: how often one more level was drawn, from the first 32 bits of its MD5."""
    u = (F.conv(F.substring(F.md5(id.cast("string")), 1, 8), 16, 10).cast("double") + 1) / 2**32
    return F.least(F.floor(F.ln(u) / F.ln(F.lit(CHANCE))), F.lit(MOST_LEVEL)).cast("int")


def select_neighbours(dist: np.ndarray, between: np.ndarray, m: int, heuristic: bool = True) -> list[int]:
    """Rows of candidates (sorted by `dist`) to link: one is taken unless a taken one is nearer to it than the
    source is; then the list is filled up by distance. Without the heuristic, the nearest m."""
    n = len(dist)
    if n <= m or not heuristic:
        return list(range(min(n, m)))
    taken: list[int] = []
    for c in range(n):
        if len(taken) < m and not any(between[c, s] < dist[c] for s in taken):
            taken.append(c)
    for c in range(n):
        if len(taken) >= m:
            break
        if c not in taken:
            taken.append(c)
    return sorted(taken)


def _selected(links: DataFrame, vectors: DataFrame, m: int, metric: str, heuristic: bool) -> DataFrame:
    """src, dst, dist: of each source's links (src, dst, dist) at most m by the rule. `vectors`: id, v."""
    near = links.join(vectors.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "dist", "v")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "dst"])
        x = np.stack([np.asarray(v, float) for v in pdf["v"]])
        keep = select_neighbours(pdf["dist"].to_numpy(), _pair_distance(metric, x, x), m, heuristic)
        return pdf.iloc[keep][["src", "dst", "dist"]]

    kind = vectors.schema["id"].dataType.simpleString()
    return near.groupBy("src").applyInPandas(pick, f"src {kind}, dst {kind}, dist double")


def neighbour_graph(
    df: DataFrame, m: int = 16, candidates: int = 32, metric: str = "cosine", id_col: str = "id", vector: str = "values", heuristic: bool = True
) -> DataFrame:
    """src, dst, dist: at most m links per vector, chosen among its nearest candidates."""
    metric = M.parse_metric(metric)
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    near = knn_join(df, candidates, metric, id_col, vector)
    back = -F.col("score") if metric == "dot" else F.col("score")
    return _selected(near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), back.alias("dist")), vectors, m, metric, heuristic)


def linked_back(links: DataFrame, vectors: DataFrame, most: int, metric: str, heuristic: bool = True) -> DataFrame:
    """Links in both directions, at most `most` per vector by the rule. `vectors`: id, v."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct()
    # the nearest 8 x most are enough to choose from; a vector that very many link to sends no more
    rows = both.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "dst"))), 1, 8 * most).alias("_l"))
    return _selected(rows.select("src", F.inline("_l")), vectors, most, M.parse_metric(metric), heuristic)


def layered_graph(
    df: DataFrame, m: int = 16, candidates: int = 32, metric: str = "cosine", id_col: str = "id", vector: str = "values", heuristic: bool = True
) -> DataFrame:
    """src, dst, dist, layer: the links of all layers that hold two vectors or more."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    sizes = rows.groupBy(level_of(F.col("id")).alias("level")).count().collect()  # at most MOST_LEVEL + 1 rows
    out = None
    for layer in range(MOST_LEVEL + 1):
        if sum(r["count"] for r in sizes if r.level >= layer) < 2 and out is not None:
            break
        part = rows.where(level_of(F.col("id")) >= layer) if layer else rows
        links = linked_back(neighbour_graph(part, m, candidates, metric, "id", "v", heuristic), part, 2 * m, metric, heuristic)
        links = links.withColumn("layer", F.lit(layer))
        out = links if out is None else out.unionByName(links)
    return out


def graph_stats(edges: DataFrame) -> DataFrame:
    """size, total_connections, min, max and mean degree of the vectors with links."""
    d = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return d.agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("degree").alias("total_connections"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
        F.avg("degree").alias("mean_degree"),
    )


def entry_point(vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """size, max_layer, entry_point: the vector of the highest level, of several the smallest id."""
    level = level_of(F.col(id_col))
    return vectors.agg(F.count(F.lit(1)).alias("size"), F.max(level).alias("max_layer"), F.min(F.struct(-level, F.col(id_col).alias("id")))["id"].alias("entry_point"))


def index_stats(edges: DataFrame | None, vectors: DataFrame, m: int, ef_construction: int, metric: str, id_col: str = "id", heuristic: bool = True) -> dict:
    """What an index says about itself: size, layers, entry point, links of all layers (None without `edges`) and its settings."""
    top = entry_point(vectors, id_col).first()
    return {
        "size": top["size"], "max_layer": top.max_layer if top.max_layer is not None else 0, "entry_point": top.entry_point,
        "total_connections": edges.count() if edges is not None else None, "m": m, "ef_construction": ef_construction, "metric": metric, "use_heuristic": heuristic,
    }


def graph_data(edges: DataFrame, max_nodes: int = 0, vectors: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """id, layer (its level) and links of layer 0, nearest first, of the first `max_nodes` ids (0 or less: all). With `vectors`,
    vectors without links are there too."""
    base = edges.where(F.col("layer") == 0) if "layer" in edges.columns else edges
    nodes = base.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("_l"))
    nodes = nodes.select(F.col("src").alias("id"), F.transform("_l", lambda x: x["dst"]).alias("links"))
    if vectors is not None:
        nodes = vectors.select(F.col(id_col).alias("id")).join(nodes, "id", "left").withColumn("links", F.coalesce("links", F.array().cast(nodes.schema["links"].dataType)))
    nodes = nodes.select("id", level_of(F.col("id")).alias("layer"), "links")
    return nodes.orderBy("id").limit(max_nodes) if max_nodes > 0 else nodes
