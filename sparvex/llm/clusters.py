"""Hierarchical density clustering of vectors.

1. Mutual-reachability graph: all links between directions (copies are one point with a weight) of a similarity of `least` or
   more, their lengths the greatest of the distance 1 - cosine and the core distances of the ends (`links`).
2. Minimum spanning forest: the regions of the vector space give their own minimum forests, edges are thinned in batches (the
   forest of a union is the forest of the union of forests), then merged by distributed Boruvka rounds: every
   component takes its shortest edge (ties by ids, so there are no longer cycles than pairs), pointers are jumped, edges
   are relabelled and parallel ones thinned. A round is written to the checkpoint folder. The rounds over the last
   `LAST_EDGES` contracted edges run in one task; the result is the same wherever they run.
3. Condensed hierarchy: a component's edges are joined from short to long, equal ones at once. A component that reaches
   `min_size` is a cluster; smaller ones that join it are members that come in at that length; where two clusters or more
   meet they end and their union begins. The components of the forest go on side by side, so one pass serves all of
   them; a component of more than `BAND_EDGES` edges is taken in bands of lengths, its parts being carried on.
4. Stability of a cluster: the sum over its members of their density 1 / length minus the cluster's own at its end (the
   density of the greatest distance for the last). From the leaves up, a cluster is chosen if it is as stable as the best
   choice below it; of chosen ones the uppermost count.
5. Each cluster gets its size, its most persistent members (those that come in at the greatest density), and for each
   metadata field the most usual value.

The flat groups of a least similarity (`similarity_groups`) are the components of the same forest, made with min_samples
of 2, where mutual reachability is the plain distance: single linkage cut at that distance.

Ties always go to the smaller id. Vectors in no cluster are noise and not listed. Unusable vectors never come
this far; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .links import link_forest
from .vectors import directions

#: The least similarity of linked vectors, and what bounds the density of vectors at one place.
LEAST, SHORTEST = 0.85, 1e-6
LAST_EDGES, BAND_EDGES = 50_000, 2_000_000


def nodes(keyed: DataFrame) -> DataFrame:
    """coll_name, dir_key, node (the smallest id), weight (the number of copies)."""
    return keyed.groupBy("coll_name", "dir_key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"))


_EDGES = "coll_name string, a string, b string, length double"


def _kruskal(t: pa.Table, a: str, b: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Rows of the forest of a table sorted by length; its nodes as "collection NUL id", and the root of each."""
    coll = t["coll_name"].combine_chunks()
    ends = pa.concat_arrays([pc.binary_join_element_wise(coll, t[c].combine_chunks(), "\0") for c in (a, b)]).dictionary_encode()
    code, names = ends.indices.to_numpy(), ends.dictionary
    parent, keep = list(range(len(names))), []
    for i, (x, y) in enumerate(zip(code[: len(t)].tolist(), code[len(t) :].tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            keep.append(i)
    root = np.array(parent, np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    return np.array(keep, np.int64), names, root


def _sorted(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("length", "coll_name", "a", "b")])


def thin(edges: DataFrame) -> DataFrame:
    """The forest of each batch of edges: edges that close a cycle inside a batch are in no minimum forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _sorted([b])
            yield from t.take(pa.array(_kruskal(t, "a", "b")[0])).to_batches()

    return edges.mapInArrow(run, _EDGES)


def _finish(e: DataFrame) -> DataFrame:
    """The last rounds in one task: edges of the forest (a, b, length) and components with their root (c, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = list(batches)
        if not all_:
            return
        t = _sorted(all_)
        keep, names, root = _kruskal(t, "ca", "cb")
        rows = t.take(pa.array(keep)).select(["coll_name", "a", "b", "length"])
        none = pa.nulls(len(rows), pa.string())
        yield from rows.append_column("c", none).append_column("p", none).to_batches()
        pair = pc.split_pattern(names, "\0", max_splits=1)
        coll, c = pc.list_element(pair, 0), pc.list_element(pair, 1)
        none = pa.nulls(len(names), pa.string())
        yield pa.RecordBatch.from_arrays([coll, none, none, pa.nulls(len(names), pa.float64()), c, c.take(pa.array(root))], names=["coll_name", "a", "b", "length", "c", "p"])

    return e.repartition(1).mapInArrow(run, _EDGES + ", c string, p string")


def spanning_forest(edges: DataFrame, rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(forest, labels): the minimum spanning forest (coll_name, a, b, length) of `edges`, and the component of
    every node with an edge (coll_name, node, label, label being the smallest node)."""
    pieces: list[DataFrame] = []
    e = cut(edges.select("coll_name", "a", "b", "length", F.col("a").alias("ca"), F.col("b").alias("cb")))
    labels = e.select("coll_name", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        left = e.count()
        if not left:
            break
        if left <= LAST_EDGES:
            done = cut(_finish(e))
            pieces.append(done.where(F.col("c").isNull()).select("coll_name", "a", "b", "length"))
            step = done.where(F.col("c").isNotNull()).select("coll_name", F.col("c").alias("label"), "p")
            labels = labels.join(step, ["coll_name", "label"], "left").select("coll_name", "node", F.coalesce("p", "label").alias("label"))
            break
        way = F.struct("length", "a", "b")
        both = e.select("coll_name", F.inline(F.array(F.struct(F.col("ca").alias("c"), way.alias("way"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("c"), way.alias("way"), F.col("ca").alias("to")))))
        best = cut(both.groupBy("coll_name", "c").agg(F.min(F.struct("way", "to")).alias("m")).select("coll_name", "c", "m.way", "m.to"))
        pieces.append(best.select("coll_name", "way.a", "way.b", "way.length"))
        back = best.select("coll_name", F.col("c").alias("to"), F.col("to").alias("back"))
        mutual = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
        step = best.join(back, ["coll_name", "to"]).select("coll_name", "c", F.when(mutual, F.col("c")).otherwise(F.col("to")).alias("p"))
        for _ in range(2):
            jump = step.select("coll_name", F.col("c").alias("p"), F.col("p").alias("q"))
            step = step.join(jump, ["coll_name", "p"]).select("coll_name", "c", F.col("q").alias("p"))
        step = cut(step)
        for end in ("ca", "cb"):
            e = e.join(step.withColumnRenamed("c", end), ["coll_name", end]).drop(end).withColumnRenamed("p", end)
        e = e.where(F.col("ca") != F.col("cb")).groupBy("coll_name", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
        e = cut(e.agg(F.min(way).alias("way")).select("coll_name", "way.*", "ca", "cb"))
        labels = labels.join(step.withColumnRenamed("c", "label"), ["coll_name", "label"], "left")
        labels = labels.select("coll_name", "node", F.coalesce("p", "label").alias("label"))
    else:
        raise RuntimeError("the forest did not close")
    # A pointer chain may have left a component under several labels; the forest joins them.
    forest = reduce(DataFrame.unionByName, pieces).distinct() if pieces else edges.select("coll_name", "a", "b", "length")
    return forest, _smallest(labels)


def _smallest(labels: DataFrame) -> DataFrame:
    first = labels.groupBy("coll_name", "label").agg(F.min("node").alias("first"))
    return labels.join(first, ["coll_name", "label"]).select("coll_name", "node", F.col("first").alias("label"))


def density_forest(keyed: DataFrame, least: float = LEAST, min_samples: int = 2) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of the mutual-reachability graph: coll_name, a, b, length, and the component of each node with an edge."""
    weights = nodes(keyed).select("coll_name", F.col("node").alias("id"), "weight")
    return spanning_forest(thin(link_forest(keyed, weights, least, min_samples)))


def similarity_groups(usable: DataFrame, least: float = LEAST) -> DataFrame:
    """coll_name, id, first_id: the flat cut of the hierarchy at similarity `least` (a group has two vectors or more)."""
    keyed = cut(directions(usable.select("coll_name", "id", "vec_values"), 1))
    _, labels = density_forest(keyed, least)
    n = nodes(keyed).join(labels, ["coll_name", "node"], "left")
    n = n.select("coll_name", "dir_key", "weight", F.coalesce("label", "node").alias("first_id"))
    big = n.groupBy("coll_name", "first_id").agg(F.sum("weight").alias("size")).where(F.col("size") > 1)
    n = n.join(big, ["coll_name", "first_id"]).select("coll_name", "dir_key", "first_id")
    return keyed.select("coll_name", "id", "dir_key").join(n, ["coll_name", "dir_key"]).select("coll_name", "id", "first_id")


class Condensed:
    """Components that grow from short edges to long ones, all of a task side by side.

    A label is a part of a component: a node, or what an earlier band has joined. `cluster` is its open cluster, `sum`
    the densities of the cluster's members, `best` the best choice below it, `pending` the labels that are in no cluster.
    """

    def __init__(self, names: list[tuple], size: list[int], cluster: list, total: list[float], best: list[float], fresh: bool, min_size: int):
        self.names, self.size, self.cluster, self.sum, self.best, self.min_size = names, size, cluster, total, best, min_size
        self.parent = list(range(len(names)))
        self.pending: list[list[int]] = [[] if c is not None else [i] for i, c in enumerate(cluster)]
        self.joins: list[tuple] = []  # label, cluster, density
        self.ended: list[tuple] = []  # label of the component, cluster, parent, size, stability, best choice below
        for i in range(len(names) if fresh else 0):
            if size[i] >= min_size:  # copies
                self._begin(i, SHORTEST, [i])

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def _enter(self, into: int, parts: list[int], density: float) -> None:
        for c in parts:
            self.joins += [(i, self.cluster[into], density) for i in self.pending[c]]
            self.pending[c] = []

    def _begin(self, at: int, length: float, small: list[int]) -> None:
        """A cluster that holds the whole component `at`, its name the component's smallest label and its length."""
        density = 1 / max(length, SHORTEST)
        self.cluster[at] = f"{self.names[at][1]}\0{length:.6f}"
        self.sum[at], self.best[at] = self.size[at] * density, 0.0
        self._enter(at, small, density)

    def end(self, c: int, density: float, parent: str | None) -> float:
        """The cluster of component `c` ends; the value of the best choice in it."""
        own = self.sum[c] - self.size[c] * density
        self.ended.append((c, self.cluster[c], parent, self.size[c], own, self.best[c]))
        return max(own, self.best[c])

    def join(self, edges: list[tuple[int, int]], length: float) -> None:
        """All edges of one length."""
        density = 1 / max(length, SHORTEST)
        before = sorted({self.find(x) for e in edges for x in e})
        for a, b in edges:
            a, b = self.find(a), self.find(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
        met: dict[int, list[int]] = {}
        for c in before:
            met.setdefault(self.find(c), []).append(c)
        for root, parts in met.items():
            if len(parts) < 2:
                continue
            big, small = [c for c in parts if self.cluster[c] is not None], [c for c in parts if self.cluster[c] is None]
            size = sum(self.size[c] for c in parts)
            if len(big) == 1:
                one = big[0]
                entered = sum(self.size[c] for c in small) * density
                self.cluster[root], self.sum[root], self.best[root] = self.cluster[one], self.sum[one] + entered, self.best[one]
                self.size[root] = size
                self._enter(root, small, density)
            elif big:
                name = f"{self.names[root][1]}\0{length:.6f}"
                below = sum(self.end(c, density, name) for c in big)
                self.size[root], self.cluster[root] = size, name
                self.sum[root], self.best[root] = size * density, below
                self._enter(root, small, density)
            else:
                self.size[root] = size
                if size >= self.min_size:
                    self._begin(root, length, parts)
                else:
                    rest = [i for c in parts for i in self.pending[c]]
                    for c in parts:
                        self.pending[c] = []
                    self.pending[root] = rest


_ROWS = "kind string, coll_name string, comp string, x string, y string, n bigint, u double, v double"


def _condense(t: pa.Table, fresh: bool, last: bool, min_size: int, root_density: float) -> pa.Table:
    """One band of a partition with whole components. Rows of `t`: labels (x, open cluster y, size n, sum u, best v) with kind
    "label", and edges (x, y, length u) with kind "edge". Gives joins (label x, cluster y, density u), ended clusters (x, parent
    y, size n, stability u, best v), labels to go on (as in `t`) and moves (pending label x, its new label y)."""
    kind = np.array(t["kind"].to_pylist(), object)
    c = t.filter(pa.array(kind == "label")).sort_by([(k, "ascending") for k in ("coll_name", "comp", "x")]).to_pydict()
    names = list(zip(c["coll_name"], c["x"]))
    comps, number = c["comp"], {name: i for i, name in enumerate(names)}
    at = Condensed(names, c["n"], c["y"], [x or 0.0 for x in c["u"]], [x or 0.0 for x in c["v"]], fresh, min_size)
    e = t.filter(pa.array(kind == "edge")).sort_by([("u", "ascending")]).to_pydict()
    same: list[tuple[int, int]] = []
    lengths = e["u"]
    for i, (coll, x, y) in enumerate(zip(e["coll_name"], e["x"], e["y"])):
        same.append((number[coll, x], number[coll, y]))
        if i + 1 == len(lengths) or lengths[i + 1] != lengths[i]:
            at.join(same, lengths[i])
            same = []
    roots = [i for i in range(len(names)) if at.find(i) == i]
    rows: list[tuple] = []
    if last:
        for r in roots:
            if at.cluster[r] is not None:
                at.end(r, root_density, None)
    else:
        rows += [("label", names[r][0], comps[r], names[r][1], at.cluster[r], at.size[r], at.sum[r], at.best[r]) for r in roots]
        rows += [("move", names[i][0], comps[i], names[i][1], names[r][1], None, None, None) for r in roots for i in at.pending[r]]
    rows += [("join", names[i][0], comps[i], names[i][1], cluster, None, density, None) for i, cluster, density in at.joins]
    rows += [("cluster", names[r][0], comps[r], cluster, parent, n, own, best) for r, cluster, parent, n, own, best in at.ended]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.float64(), pa.float64()]
    cols = list(zip(*rows)) if rows else [[]] * 8
    return pa.table([pa.array(list(x), k) for x, k in zip(cols, kinds)], names=["kind", "coll_name", "comp", "x", "y", "n", "u", "v"])


def _chosen(t: pa.Table) -> pa.Table:
    """x (cluster) and y (the chosen cluster that holds it) of whole components; clusters that none holds are left out."""
    c = t.to_pydict()
    up = {(coll, x): (y, u >= v) for coll, x, y, u, v in zip(*(c[k] for k in ("coll_name", "x", "y", "u", "v")))}
    holder: dict[tuple, str | None] = {}
    for key in up:
        way = []
        while key is not None and key not in holder:
            way.append(key)
            parent = up[key][0]
            key = (key[0], parent) if parent is not None else None
        held = holder[key] if key is not None else None
        for k in reversed(way):
            held = held if held is not None else k[1] if up[k][1] else None
            holder[k] = held
    rows = [(coll, x, y) for (coll, x), y in holder.items() if y is not None]
    return pa.table([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["coll_name", "x", "y"])


def _whole(df: DataFrame, run, schema: str) -> DataFrame:
    """`run` over partitions of whole components."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = list(batches)
        if all_:
            yield from run(pa.Table.from_batches(all_).combine_chunks()).to_batches()

    return df.repartition("coll_name", "comp").mapInArrow(parts, schema)


def stable_clusters(forest: DataFrame, labels: DataFrame, weights: DataFrame, least: float = LEAST, min_size: int = 5, band_edges: int | None = None) -> DataFrame:
    """coll_name, node, cluster, density: the chosen cluster of each node that is in one, and the density at which the node
    comes into the hierarchy. weights: coll_name, node, weight."""
    band_edges = band_edges or BAND_EDGES
    where = weights.join(labels, ["coll_name", "node"], "left").select("coll_name", "node", "weight", F.coalesce("label", "node").alias("comp"))
    # a node without an edge is a cluster only by its copies
    where = where.join(labels.select("coll_name", "node", F.lit(True).alias("_linked")), ["coll_name", "node"], "left")
    where = cut(where.where(F.col("_linked") | (F.col("weight") >= min_size)).drop("_linked"))
    comp = labels.select("coll_name", F.col("node").alias("a"), F.col("label").alias("comp"))
    edges = cut(forest.join(comp, ["coll_name", "a"]).select("coll_name", "comp", "a", "b", "length"))
    big = edges.groupBy("coll_name", "comp").count().where(F.col("count") > band_edges)
    most = big.agg(F.max("count")).first()[0] or 1
    bands = -(-most // band_edges)
    cuts = [-1.0, 3.0]
    if bands > 1:
        inner = edges.join(big, ["coll_name", "comp"]).agg(F.percentile_approx("length", [i / bands for i in range(1, bands)], 10_000)).first()[0]
        cuts = sorted({-1.0, 3.0, *inner})
    none = [F.lit(None).cast(k).alias(c) for c, k in (("y", "string"), ("u", "double"), ("v", "double"))]
    state = where.select(F.lit("label").alias("kind"), "coll_name", "comp", F.col("node").alias("x"), none[0], F.col("weight").alias("n"), *none[1:])
    at = where.select("coll_name", "node", F.col("node").alias("label"))
    joined, ended = [], []
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        fresh, last = i == 0, i == len(cuts) - 2
        band = edges.where((F.col("length") > low) & (F.col("length") <= high))
        if not fresh:
            for end in ("a", "b"):
                band = band.join(now.select("coll_name", F.col("node").alias(end), F.col("label").alias(f"_{end}")), ["coll_name", end])  # noqa: F821
            band = band.select("coll_name", "comp", F.col("_a").alias("a"), F.col("_b").alias("b"), "length").where(F.col("a") != F.col("b"))
        rows = band.select(F.lit("edge").alias("kind"), "coll_name", "comp", F.col("a").alias("x"), F.col("b").alias("y"), F.lit(None).cast("bigint").alias("n"), F.col("length").alias("u"), none[2])
        run = lambda t, fresh=fresh, last=last: _condense(t, fresh, last, min_size, 1 / (1 - least))
        out = cut(_whole(state.unionByName(rows), run, _ROWS))
        join = out.where("kind = 'join'").select("coll_name", F.col("x").alias("label"), F.col("y").alias("cluster"), F.col("u").alias("density"))
        joined.append(at.join(join, ["coll_name", "label"]).select("coll_name", "node", "cluster", "density"))
        ended.append(out.where("kind = 'cluster'"))
        if not last:
            state = out.where("kind = 'label'")
            # every node's label, for the edges, and the nodes that are in no cluster yet
            roots = cut(_whole(rows.select("coll_name", "comp", "x", "y"), _roots, "coll_name string, comp string, label string, root string"))
            before = at.select("coll_name", "node", "label") if fresh else now  # noqa: F821
            now = cut(before.join(roots.drop("comp"), ["coll_name", "label"], "left").select("coll_name", "node", F.coalesce("root", "label").alias("label")))
            moves = out.where("kind = 'move'").select("coll_name", F.col("x").alias("label"), F.col("y").alias("_to"))
            at = cut(at.join(moves, ["coll_name", "label"]).select("coll_name", "node", F.col("_to").alias("label")))
    joined, ended = reduce(DataFrame.unionByName, joined), reduce(DataFrame.unionByName, ended)
    held = _whole(ended, _chosen, "coll_name string, x string, y string").select("coll_name", F.col("x").alias("cluster"), F.col("y").alias("_chosen"))
    return joined.join(held, ["coll_name", "cluster"]).select("coll_name", "node", F.col("_chosen").alias("cluster"), "density")


def _roots(t: pa.Table) -> pa.Table:
    """The smallest label that each label of a band's edges is joined with."""
    ends: dict[tuple, tuple] = {}

    def find(x):
        while ends.setdefault(x, x) != x:
            ends[x] = x = ends[ends[x]]
        return x

    comp: dict[tuple, str] = {}
    for coll, c, x, y in zip(*(t[k].to_pylist() for k in ("coll_name", "comp", "x", "y"))):
        a, b = find((coll, x)), find((coll, y))
        comp[coll, x] = comp[coll, y] = c
        if a != b:
            ends[max(a, b)] = min(a, b)
    rows = [(x[0], comp[x], x[1], find(x)[1]) for x in list(ends)]
    return pa.table([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["coll_name", "comp", "label", "root"])


def clusters(usable: DataFrame, min_size: int = 5, min_samples: int = 3, least: float = LEAST, exemplars: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, descriptions).

    members: coll_name, id, cluster (its smallest id), persistence (the density, 1 / distance, at which the member comes
    into the hierarchy). descriptions: coll_name, cluster, size, exemplars, usual.
    """
    keyed = cut(directions(usable, 1))
    forest, labels = density_forest(keyed, least, min_samples)
    all_ = cut(nodes(keyed))
    member = stable_clusters(cut(forest), cut(labels), all_.drop("dir_key"), least, min_size)
    member = cut(member.join(all_.drop("weight"), ["coll_name", "node"]))
    first = member.groupBy("coll_name", "cluster").agg(F.min("node").alias("_first"))
    member = member.join(first, ["coll_name", "cluster"]).select("coll_name", "dir_key", F.col("_first").alias("cluster"), F.col("density").alias("persistence"))
    keep = [c for c in ("metadata",) if c in keyed.columns]
    members = cut(keyed.select("coll_name", "id", "dir_key", *keep).join(member, ["coll_name", "dir_key"]).drop("dir_key"))
    return members, describe(members, exemplars)


def describe(members: DataFrame, exemplars: int = 3) -> DataFrame:
    """coll_name, cluster, size, exemplars (ids, the most persistent first), usual (field to its most usual value).

    Values of readable metadata are compared without case and outer blanks; counts are reduced before any
    cluster's rows meet.
    """
    size = members.groupBy("coll_name", "cluster").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("coll_name", "cluster").orderBy(F.desc("persistence"), "id")
    typical = members.select("coll_name", "cluster", "id", "persistence", F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= exemplars)
    typical = typical.groupBy("coll_name", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "id"))), lambda x: x["id"]).alias("exemplars"))
    out = size.join(typical, ["coll_name", "cluster"])
    if "metadata" not in members.columns:
        return out
    fields = F.from_json("metadata", "map<string,string>")
    values = members.select("coll_name", "cluster", F.explode(fields).alias("field", "value")).where(F.col("value").isNotNull())
    values = values.groupBy("coll_name", "cluster", "field", F.lower(F.trim("value")).alias("value")).agg((-F.count(F.lit(1))).alias("_n"))
    usual = values.groupBy("coll_name", "cluster", "field").agg(F.min(F.struct("_n", "value")).alias("_m"))
    usual = usual.groupBy("coll_name", "cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "_m.value")))).alias("usual"))
    return out.join(usual, ["coll_name", "cluster"], "left")
