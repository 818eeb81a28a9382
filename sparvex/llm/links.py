"""The minimum spanning forest of all links of a least similarity between the directions of a collection.

A link's length is its mutual reachability: the greatest of the distance 1 - cosine and the core distances of its ends. No
link is left out: a vector is kept from a list only by a bound on the similarity of any member of the list.
1. Lists: nearest centres, fitted on a bounded sample. A list has an inner part, the vectors of a cosine of `INNER` or
   more with its centre, and an outer one. Parts form regions of about `REGION_ROWS` vectors; a region with more members is
   split into parts, one with many visitors into slices of them, so a task's rows are bounded.
2. Bounds, for a vector q, a centre c and the smallest similarity's angle t and chord d: members of another list are on
   the other side of the plane between q's own centre and c, so q must be within d of it; members of an inner part
   need an angle of q and c up to acos(INNER) + t, those of an outer one an angle of acos(INNER) - t or more.
3. Of two regions one is visited by the vectors of the other that no bound keeps away: outer regions by half of the outer
   ones, inner ones by outer ones and half of the inner ones.
4. In a region the links of a list and its queries are taken block by block; each block gives its minimum forest by Boruvka
   rounds on the block's own similarities (every component takes its best link to another), and the blocks' forests give the
   region's. The forest of a union is the forest of the union of forests, so nothing that the whole needs is lost.

The core distance of a vector is the distance to its (min_samples - 1)-th other vector, copies counted one by one; it is
found over the same links. A vector without one within the least similarity has no link. With min_samples of 2 or
less mutual reachability is the plain distance.

Vectors in no dense place can't be told apart by bounds, so the work for them grows with the square of their number, and
so does that of a group of mutually similar ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from math import acos, cos, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import LIST_ROWS, _kmeans, _nearest, _regions, fit_models, units
from .vectors import matrix, unit

INNER, ROWS = 0.8, 2048
MAX_LISTS, REGION_ROWS = 1024, 24_576
#: Rounding of float32 similarities, and what the bounds are slackened by.
NEAR, SLACK = 1e-5, 1e-4


@dataclass
class Lists:
    """The two parts of lists are numbered: the outer ones, then the inner ones in the same order. So are regions."""

    centres: np.ndarray  # (lists, dim) unit vectors
    apart: np.ndarray  # (lists, lists): distances of the centres
    regions: np.ndarray  # (2 x lists,)
    parts: np.ndarray  # (regions,): into how many parts the members of a region are split
    slices: np.ndarray  # (regions,): into how many slices those who ask in a region are split
    outer: int  # the number of outer regions


def fit_lists(x: np.ndarray, rows: int, least: float) -> Lists:
    x = x.astype(np.float32)
    k = int(min(max(1, rows // LIST_ROWS), MAX_LISTS, max(1, len(x) // 8)))
    c = _kmeans(x, k, np.random.default_rng(0))
    near = _nearest(x, c)
    inner = np.einsum("nd,nd->n", x, c[near]) >= INNER
    regions, parts, first, times = [], [], 0, rows / max(len(x), 1)
    for part in (~inner, inner):
        estimate = np.bincount(near[part], minlength=k) * times
        r = _regions(c, estimate, REGION_ROWS)
        parts.append(np.maximum(np.ceil(np.bincount(r, estimate) / REGION_ROWS - 0.25), 1).astype(int))
        regions.append(r + first)
        first += len(parts[-1])
    c64 = c.astype(np.float64)
    apart = np.sqrt(np.maximum(2 - 2 * c64 @ c64.T, 0)).astype(np.float32)
    m = Lists(c, apart, np.concatenate(regions), np.concatenate(parts), np.ones(first, int), len(parts[0]))
    asking = np.zeros(first)
    for i in range(0, len(x), 1024):
        asking += asked_regions(m, *may_link(m, x[i : i + 1024], least))[1].sum(0)
    m.slices = np.maximum(np.ceil(asking * times / (2 * REGION_ROWS) - 0.25), 1).astype(int)
    return m


def may_link(m: Lists, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(own part, mask of the parts that may hold a vector of similarity `least` or more) of each row."""
    s = x @ m.centres.T
    own = np.argmax(s, 1)
    top = s[np.arange(len(x)), own]
    t, ball = acos(least - SLACK), acos(INNER)
    reach = top[:, None] - s <= (sqrt(2 - 2 * (least - SLACK)) + SLACK) * m.apart[own] + SLACK
    low = cos(ball + t) if ball + t < pi else -2.0
    high = cos(ball - t) if ball > t else 2.0
    k = len(m.centres)
    return own + np.where(top >= INNER, k, 0), np.concatenate([reach & (s <= high + SLACK), reach & (s >= low - SLACK)], 1)


def asked_regions(m: Lists, own: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home region, mask of the regions a row asks in): its own one, and of two regions the one whose turn it is."""
    all_, home = len(m.parts), m.regions[own]
    asks = np.zeros((len(own), all_), bool)
    row, one = np.nonzero(mask)
    asks[row, m.regions[one]] = True
    to, at, inner = np.arange(all_)[None], home[:, None], max(all_ - m.outer, 1)
    both_outer, both_inner = (to < m.outer) & (at < m.outer), (to >= m.outer) & (at >= m.outer)
    gap = (to - at) % np.where(both_outer, max(m.outer, 1), inner)
    half = np.where(both_outer, max(m.outer, 1), inner)
    turn = (both_outer | both_inner) & ((2 * gap < half) | ((2 * gap == half) & (to > at)))
    asks &= turn | ((to >= m.outer) & (at < m.outer)) | (to == at)
    asks[np.arange(len(own)), home] = True
    return home, asks


_PLACED = "coll_name string, region int, member boolean, asks boolean, id string, vec_values array<float>, weight bigint, core double"


def _place(models: dict[str, Lists], batch: pa.RecordBatch, least: float):
    names = np.array(batch.column("coll_name").to_pylist())
    for name in sorted(set(names)):
        m = models[name]
        part = batch.take(pa.array(np.flatnonzero(names == name)))
        values = matrix(part.column("vec_values"), np.float32)
        home, asks = asked_regions(m, *may_link(m, unit(values.astype(np.float64)).astype(np.float32), least))
        lot = (np.ascontiguousarray(values).view(np.uint32).astype(np.uint64).sum(1) * np.uint64(0x9E3779B1) >> np.uint64(12)).astype(np.int64)
        row, unit_, member, asking = units(m, home, asks, lot)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(row), pa.string()), pa.array(unit_.astype(np.int32)), pa.array(member), pa.array(asking),
                *(part.column(c).take(take) for c in ("id", "vec_values", "weight", "core")),
            ],
            names=["coll_name", "region", "member", "asks", "id", "vec_values", "weight", "core"],
        )


def _blocks(m: Lists, x: np.ndarray, x32: np.ndarray, member: np.ndarray, asks: np.ndarray, least: float):
    """(rows, columns, similarities, which rows are of the columns' list) of all links of a member with an asking row: -1
    where there is none. Similarities near the least one are decided in float64."""
    own, mask = may_link(m, x32, least)
    for one in np.unique(own[member]).tolist():
        mine = np.flatnonzero(member & (own == one))
        # of two members the one of the later part is the query
        ask = np.flatnonzero(asks & ((mask[:, one] & (~member | (own > one))) | (member & (own == one))))
        for i in range(0, len(mine), ROWS):
            for j in range(0, len(ask), ROWS):
                a, b = ask[j : j + ROWS], mine[i : i + ROWS]
                s = x32[a] @ x32[b].T
                rows, cols = np.flatnonzero(s.max(1) >= least - NEAR), np.flatnonzero(s.max(0) >= least - NEAR)
                if not len(rows):
                    continue
                a, b, s = a[rows], b[cols], s[np.ix_(rows, cols)]
                r, c = np.nonzero(np.abs(s - least) <= NEAR)
                s[r, c] = np.where(np.round(np.einsum("nd,nd->n", x[a[r]], x[b[c]]), 6) >= least - 1e-9, least, -1)
                s[s < least - NEAR] = -1
                s[a[:, None] == b[None]] = -1
                if s.max() > -1:
                    yield a, b, s, member[a] & (own[a] == one)


class _Union:
    """Joins of rows; which joins made one of two components."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        made = []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                made.append(i)
        return made

    def labels(self) -> np.ndarray:
        p = np.array(self.parent)
        while (p[p] != p).any():
            p = p[p]
        return p


def block_forest(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) of the maximum spanning forest of a block, by Boruvka rounds."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    known, label, out = _Union(len(nodes)), np.arange(len(nodes)), []
    while True:
        # the largest component waits: the others reach it, and their best links are enough
        count = np.bincount(label, minlength=len(nodes))
        wait = np.argmax(count) if count.max() > 1 else -1
        r, c = np.flatnonzero(label[ia] != wait), np.flatnonzero(label[ib] != wait)
        ends = []
        for rows, cols in ((r, np.arange(len(b))), (np.arange(len(a)), c)):
            if len(rows) and len(cols):
                axis = 1 if len(cols) == len(b) and rows is r else 0
                part = s[np.ix_(rows, cols)] if len(rows) < len(a) or len(cols) < len(b) else s
                other = np.where(label[ia[rows]][:, None] != label[ib[cols]][None], part, -1)
                best = other.argmax(axis)
                value = np.take_along_axis(other, np.expand_dims(best, axis), axis).squeeze(axis)
                ok = value > -1
                p, q = (ia[rows], ib[cols[best]]) if axis == 1 else (ia[rows[best]], ib[cols])
                own = label[p] if axis == 1 else label[q]
                ends.append(np.stack([own, p, q])[:, ok].tolist() + [value[ok]])
        p, q, own = (np.concatenate([np.array(e[i], int) for e in ends]) if ends else np.zeros(0, int) for i in (1, 2, 0))
        value = np.concatenate([e[3] for e in ends]) if ends else np.zeros(0)
        if not len(p):
            break
        low, high = np.minimum(p, q), np.maximum(p, q)
        order = np.lexsort((high, low, -value, own))
        first = order[np.append(True, own[order[1:]] != own[order[:-1]])]
        first = first[np.lexsort((high[first], low[first], -value[first]))]  # the best first, so that equal ones close no cycle
        made = first[known.join(p[first], q[first])]
        out.append((nodes[p[made]], nodes[q[made]], value[made]))
        label = known.labels()
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def forest_of(m: Lists, x: np.ndarray, member: np.ndarray, asks: np.ndarray, core: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of the minimum forest of all links of a member with an asking row. x: unit vectors (float64)."""
    x32, most = x.astype(np.float32), (1 - core).astype(np.float32)
    found = []
    for a, b, s, _ in _blocks(m, x, x32, member, asks, least):
        if (core > 0).any():
            s = np.where(s > -1, np.minimum(s, np.minimum(most[a][:, None], most[b][None])), -1)
            s[s < least - NEAR] = -1
        found.append(block_forest(a, b, s))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    a, b, s = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), -s))
    made = order[_Union(len(x)).join(a[order], b[order])]
    return a[made], b[made]


def nearest_of(m: Lists, x: np.ndarray, member: np.ndarray, asks: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, cosine): the k nearest by links of a member with an asking row, of both ends."""
    x32 = x.astype(np.float32)
    best, other = np.full((len(x), 2 * k), -1, np.float32), np.full((len(x), 2 * k), -1, np.int64)

    def keep(rows: np.ndarray, cols: np.ndarray, s: np.ndarray) -> None:
        n = min(k, s.shape[1])
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        best[rows, k : k + n], other[rows, k : k + n] = np.take_along_axis(s, top, 1), cols[top]
        best[rows, k + n :] = -1
        sort = np.argsort(-best[rows], axis=1, kind="stable")
        best[rows], other[rows] = np.take_along_axis(best[rows], sort, 1), np.take_along_axis(other[rows], sort, 1)

    for a, b, s, same in _blocks(m, x, x32, member, asks, least):
        # of two members of one list each is a row and a column, so one direction is enough for those
        keep(a, b, s)
        s[same] = -1
        if s.max() > -1:
            keep(b, a, np.ascontiguousarray(s.T))
    row, place = np.nonzero(best[:, :k] > -1)
    to = other[row, place]
    return row, to, np.round(np.einsum("nd,nd->n", x[row], x[to]), 6)


def _searched(keyed: DataFrame, least: float, models, finish: Callable[[Lists, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`finish` over the rows of every unit. keyed: coll_name, id, vec_values, weight, core of each direction."""

    def place(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                yield from _place(models.value, b.slice(i, 2048), least)

    def search(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        name, t = key[0].as_py(), t.combine_chunks()
        out = finish(models.value[name], t)
        return out.add_column(0, "coll_name", pa.array([name] * len(out), pa.string()))

    return keyed.mapInArrow(place, _PLACED).groupBy("coll_name", "region").applyInArrow(search, schema)


def _flags(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(t[c].to_numpy(zero_copy_only=False) for c in ("member", "asks"))


def core_distances(heads: DataFrame, least: float, min_samples: int, models) -> DataFrame:
    """coll_name, id, core of the directions that have one. heads: coll_name, id, vec_values, weight."""

    def finish(m: Lists, t: pa.Table) -> pa.Table:
        x, ids, weight = unit(matrix(t["vec_values"])), t["id"].combine_chunks(), t["weight"].to_numpy()
        row, to, s = nearest_of(m, x, *_flags(t), least, min_samples - 1)
        return pa.table({"id": ids.take(pa.array(row)), "to": ids.take(pa.array(to)), "far": np.round(-1e6 * s).astype(np.int32), "n": weight[to]})

    # each other direction stands for one vector or more, so the first (min_samples - 1) of every unit are enough
    others = _searched(heads.withColumn("core", F.lit(0.0)), least, models, finish, "coll_name string, id string, to string, far int, n bigint")
    own = heads.where(F.col("weight") > 1).select("coll_name", "id", F.col("id").alias("to"), F.lit(-1_000_000).alias("far"), (F.col("weight") - 1).alias("n"))
    steps = own.unionByName(others).groupBy("coll_name", "id").agg(F.array_sort(F.collect_set(F.struct("far", "to", "n"))).alias("steps"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("core"))

    def step(so_far, one):
        core = F.when((so_far["seen"] < min_samples - 1) & (so_far["seen"] + one["n"] >= min_samples - 1), 1 + one["far"] / 1e6)
        return F.struct((so_far["seen"] + one["n"]).alias("seen"), F.coalesce(core, so_far["core"]).alias("core"))

    return steps.select("coll_name", "id", F.aggregate("steps", start, step)["core"].alias("core")).where(F.col("core").isNotNull())


def link_forest(keyed: DataFrame, weights: DataFrame, least: float, min_samples: int = 2) -> DataFrame:
    """coll_name, a, b (a < b), length: the regions' minimum forests of all links of `least` or more.

    keyed: the rows of `vectors.directions`; it is read several times, so pass a checkpointed table. weights: coll_name, id,
    weight of the directions; read only if min_samples is more than 2.
    """
    models = keyed.sparkSession.sparkContext.broadcast(fit_models(keyed, partial(fit_lists, least=least)))
    heads = keyed.where(F.col("ids").isNotNull()).select("coll_name", "id", "vec_values")
    if min_samples > 2:
        heads = heads.join(weights, ["coll_name", "id"])
        heads = heads.join(core_distances(heads, least, min_samples, models), ["coll_name", "id"])
    else:
        heads = heads.select("*", F.lit(1).cast("bigint").alias("weight"), F.lit(0.0).alias("core"))

    def finish(m: Lists, t: pa.Table) -> pa.Table:
        x, ids, core = unit(matrix(t["vec_values"])), t["id"].combine_chunks(), t["core"].to_numpy()
        a, b = forest_of(m, x, *_flags(t), core, least)
        length = np.round(np.maximum(1 - np.einsum("nd,nd->n", x[a], x[b]), np.maximum(core[a], core[b])), 6)
        a, b = ids.take(pa.array(a)), ids.take(pa.array(b))
        less = pc.less(a, b)
        return pa.table({"a": pc.if_else(less, a, b), "b": pc.if_else(less, b, a), "length": length})

    return _searched(heads.select("coll_name", "id", "vec_values", "weight", "core"), least, models, finish, "coll_name string, a string, b string, length double")
