"""The k most similar vectors of every vector, by score-aware quantisation.

Plan
1. Copies (also scaled ones) become one direction with its few smallest ids (`vectors.directions`).
2. Fit per collection on a bounded sample (`sample_rows`, chosen by id hash): lists (spherical k-means, about
   `LIST_ROWS` vectors each, at most `MAX_LISTS`), inside each list about one cell per `CELL_ROWS` vectors, and a
   code book of sixteen words for each block of `WIDTH` dimensions for the residuals from the cells' means. The code
   book and the codes minimise the anisotropic loss: the part of the residual error that is parallel to the data
   point, which distorts large inner products, weighs `eta` times the rest.
   Nearby lists form regions of about `REGION_ROWS` vectors. A region is the unit of work, and its size does not grow with the
   collection; a list with more rows is split into parts, and a region with many visitors into slices of them.
3. Every direction goes to its list's region and visits other regions that hold lists it probes: `VISITS` regions at most,
   its own included, so a vector is sent at most so often and looks at a bounded number of others.
   Which of a region's lists it probes is sent with it, so a region needs no others.
   Probes: all lists with a cell whose centre has a cosine of `DENSE` or more, so that a large dense group is
   searched whole; for vectors with few rows (`ENOUGH`) in such cells also a share of the nearest ones (`Budget`), within `MAX_PROBES`.
4. In a region, its members are coded, and the vectors that the codes stand for are multiplied with a batch of queries, list
   by list. The sums are those of tables of partial scores, but a matrix product adds them up in half the time of look-ups in
   numpy, and without rounding them to sixteen bits. The best of the region (`Budget`) are scored again exactly (float64).
5. The regions' results of a query are merged; ids of copies are put in; ties go to the smaller id.

All rows are indexed and all rows are queries. Null, wrong, zero and NaN values never come this far
(`vectors.usable_vectors`); an empty table gives an empty result; a collection of one vector has no neighbours.
Up to about VISITS x REGION_ROWS vectors a vector in no dense place is compared with nearly all of its collection, by codes; beyond
that with the nearest regions only, and its recall falls with the collection's size. So does that of a dense group that
fills more than VISITS regions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .vectors import directions, matrix, unit

SAMPLE_ROWS, MOST_SAMPLE = 8_192, 131_072
LIST_ROWS, CELL_ROWS, MAX_LISTS = 256, 16, 16_384
REGION_ROWS, VISITS = 12_288, 4
DENSE, ENOUGH, MAX_PROBES, EXACT = 0.8, 12, 256, 12
THRESHOLD = 0.45
#: Dimensions per block of the code book.
WIDTH = 1
_BATCH, _BLOCK = 128, 512


def sample_rows(rows: int) -> int:
    """How many of a collection's rows the index is fitted on: eight per list, within bounds."""
    return min(max(SAMPLE_ROWS, 8 * rows // LIST_ROWS), MOST_SAMPLE)


@dataclass(frozen=True)
class Budget:
    """How much a search looks at: the nearest lists that a vector in no dense place probes at least, the share of the lists
    if that is more, and the candidates scored exactly per region."""

    least: int = 16
    share: float = 0.15
    rerank: int = 96


@dataclass
class Model:
    """What the index of one collection needs; its size is bounded by MAX_LISTS."""

    centres: np.ndarray  # (lists, dim) unit vectors
    cells: np.ndarray  # (cells,): the list of each cell, ascending
    means: np.ndarray  # (cells, dim)
    counts: np.ndarray  # (cells,): how many rows each has, by the sample
    regions: np.ndarray  # (lists,)
    parts: np.ndarray  # (regions,): into how many parts the members of a region are split
    slices: np.ndarray  # (regions,): into how many slices those who ask in a region are split
    words: np.ndarray  # (blocks, 16, WIDTH)
    eta: float


def _blocks(x: np.ndarray) -> np.ndarray:
    """Blocks of WIDTH dimensions, padded to an even number of blocks."""
    pad = -x.shape[1] % (2 * WIDTH)
    if pad:
        x = np.concatenate([x, np.zeros((len(x), pad), x.dtype)], 1)
    return np.ascontiguousarray(x.reshape(len(x), -1, WIDTH))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        empty = norm[:, 0] < 1e-6
        c = np.where(empty[:, None], c, total / np.maximum(norm, 1e-6)).astype(x.dtype)
        if empty.any():
            c[empty] = x[rng.choice(len(x), int(empty.sum()), replace=len(x) < empty.sum())]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _regions(c: np.ndarray, rows: np.ndarray, most: float) -> np.ndarray:
    """Halve the lists along their main direction until a part holds at most `most` rows."""
    out, todo, n = np.zeros(len(c), np.int32), [np.arange(len(c))], 0
    while todo:
        part = todo.pop()
        if len(part) == 1 or rows[part].sum() <= most:
            out[part] = n
            n += 1
            continue
        x = c[part] - c[part].mean(0)
        axis = np.linalg.eigh(x.T @ x)[1][:, -1]
        order = part[np.argsort(x @ axis, kind="stable")]
        half = np.searchsorted(np.cumsum(rows[order]), rows[order].sum() / 2)
        half = min(max(int(half), 1), len(part) - 1)
        todo += [order[:half], order[half:]]
    return out


def _sizes(m: Model, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The size per dimension of the residuals of each cell; one for cells without rows."""
    square = ((x - m.means[cells]) ** 2).mean(1)
    n = np.bincount(cells, minlength=len(m.means))
    return np.where(n > 0, np.maximum(np.sqrt(np.bincount(cells, square, len(m.means)) / np.maximum(n, 1)), 1e-6), 1.0).astype(np.float32)


def _in_space(c: np.ndarray) -> np.ndarray:
    """An order of centres in which neighbours in space are near: halves along the main direction, again and again."""
    out, todo = [], [np.arange(len(c))]
    while todo:
        part = todo.pop()
        if len(part) <= 2:
            out.append(part)
            continue
        x = c[part] - c[part].mean(0)
        axis = np.linalg.eigh(x.T @ x)[1][:, -1]
        order = part[np.argsort(x @ axis, kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return np.concatenate(out)


def _residuals(m: Model, x: np.ndarray, cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Residuals from the cells' means, brought to unit size per dimension."""
    return _blocks((x - m.means[cells]) / sizes[cells, None])


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cell_of(m: Model, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """The cell of each row inside its list."""
    out = np.zeros(len(x), np.int32)
    for one in np.unique(lists):
        a, b = np.searchsorted(m.cells, [one, one + 1])
        rows = np.flatnonzero(lists == one)
        out[rows] = a + np.argmax(x[rows] @ m.means[a:b].T - (m.means[a:b] ** 2).sum(1) / 2, 1)
    return out


def _choose_numbers(r: np.ndarray, u: np.ndarray, words: np.ndarray, eta: float, passes: int) -> np.ndarray:
    """`_choose` for blocks of one dimension, where the loss is a parabola: its best word is the one nearest to the lowest point."""
    r, u = np.ascontiguousarray(r[:, :, 0].T), np.ascontiguousarray(u[:, :, 0].T)
    order = np.argsort(words[:, :, 0], axis=1, kind="stable")
    ascending = np.take_along_axis(words[:, :, 0], order, 1)
    middle = (ascending[:, 1:] + ascending[:, :-1]) / 2
    at = np.stack([(x > m[:, None]).sum(0, dtype=np.uint8) for m, x in zip(middle, r)])
    error = r - np.take_along_axis(ascending, at, 1)
    along = (error * u).sum(0)
    pull = (eta - 1) * u / (1 + (eta - 1) * u**2)
    for _ in range(passes):
        for b in range(len(r)):
            rest = along - error[b] * u[b]
            at[b] = (r[b] + pull[b] * rest > middle[b][:, None]).sum(0, dtype=np.uint8)
            error[b] = r[b] - ascending[b][at[b]]
            along = rest + error[b] * u[b]
    return np.take_along_axis(order, at, 1).T.astype(np.uint8)


def _choose(r: np.ndarray, u: np.ndarray, words: np.ndarray, eta: float, passes: int) -> np.ndarray:
    """Codes (rows, blocks) that lower the anisotropic loss, by coordinate descent over the blocks."""
    if r.shape[2] == 1:
        return _choose_numbers(r, u, words, eta, passes)
    n, blocks = len(r), r.shape[1]
    square = (words**2).sum(2)
    codes = np.empty((n, blocks), np.uint8)
    for b in range(blocks):
        codes[:, b] = np.argmin(square[b] - 2 * r[:, b] @ words[b].T, 1)
    error = r - words[np.arange(blocks), codes]
    along = np.einsum("nbd,nbd->n", error, u)
    for _ in range(passes):
        for b in range(blocks):
            rest = along - np.einsum("nd,nd->n", error[:, b], u[:, b])
            # for word w: |r-w|^2 + (eta-1) (rest + (r-w).u)^2
            side = (rest + np.einsum("nd,nd->n", r[:, b], u[:, b]))[:, None] - u[:, b] @ words[b].T
            loss = square[b] - 2 * r[:, b] @ words[b].T + (eta - 1) * side**2
            codes[:, b] = np.argmin(loss, 1)
            error[:, b] = r[:, b] - words[b][codes[:, b]]
            along = rest + np.einsum("nd,nd->n", error[:, b], u[:, b])
    return codes


def _fit_words(r: np.ndarray, u: np.ndarray, eta: float, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    n, blocks = len(r), r.shape[1]
    words = r[rng.integers(0, n, 16)].transpose(1, 0, 2).copy() + rng.normal(0, 1e-4, (blocks, 16, WIDTH)).astype(r.dtype)
    for i in range(rounds):
        codes = _choose(r, u, words, eta, passes=int(i > 2))
        error = r - words[np.arange(blocks), codes]
        along = np.einsum("nbd,nbd->n", error, u)
        for b in range(blocks):
            rest = along - np.einsum("nd,nd->n", error[:, b], u[:, b])
            c, ub, rb = codes[:, b], u[:, b], r[:, b]
            left = np.zeros((16, WIDTH, WIDTH))
            right = np.zeros((16, WIDTH))
            pull = (eta - 1) * (rest + np.einsum("nd,nd->n", rb, ub))
            for p in range(WIDTH):
                right[:, p] = np.bincount(c, rb[:, p] + pull * ub[:, p], 16)
                for q in range(WIDTH):
                    left[:, p, q] = np.bincount(c, (eta - 1) * ub[:, p] * ub[:, q] + (p == q), 16)
            used = np.bincount(c, minlength=16) > 0
            words[b][used] = np.linalg.solve(left[used] + 1e-6 * np.eye(WIDTH), right[used][:, :, None])[:, :, 0]
            error[:, b] = rb - words[b][c]
            along = rest + np.einsum("nd,nd->n", error[:, b], ub)
    return words.astype(np.float32)


def fit(x: np.ndarray, rows: int, seed: int = 0) -> Model:
    """Fit the index of one collection on a sample `x` (unit vectors) of its `rows` vectors."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    k = int(min(max(1, rows // LIST_ROWS), MAX_LISTS, max(1, len(x) // 8)))
    centres = _kmeans(x, k, rng)
    centres = centres[_in_space(centres)]
    near = _nearest(x, centres)
    count = np.bincount(near, minlength=k)
    cells, means, counts = [], [], []
    for one in range(k):
        mine = x[near == one]
        parts = int(max(1, min(round(count[one] * rows / len(x) / CELL_ROWS), len(mine) // 4)))
        cells += [one] * parts
        if parts > 1:
            c = _kmeans(mine, parts, rng, 6)
            at = _nearest(mine, c)
            c = np.stack([mine[at == i].mean(0) if (at == i).any() else c[i] for i in range(parts)])
            counts.append(np.bincount(at, minlength=parts))
        else:
            c = (mine.mean(0) if len(mine) else centres[one])[None]
            counts.append(np.array([len(mine)]))
        means.append(c)
    one = np.ones(1, int)
    times = rows / max(len(x), 1)
    m = Model(centres, np.array(cells), np.concatenate(means).astype(np.float32), np.concatenate(counts) * times, np.zeros(k, int), one, one, np.zeros(0), 1.0)
    m.regions = _regions(centres, count * times, REGION_ROWS)
    members = np.bincount(m.regions, count * times)
    m.parts = np.maximum(np.ceil(members / REGION_ROWS - 0.25), 1).astype(int)
    asking = np.zeros(len(m.parts))
    for i in range(0, len(x), 1024):
        asking += visits(m, *probes(m, x[i : i + 1024])[:3])[0].sum(0)
    m.slices = np.maximum(np.ceil(asking * times / (VISITS * REGION_ROWS) - 0.25), 1).astype(int)
    cell = cell_of(m, x, near)
    m.eta = max(1.0, (x.shape[1] - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    some = rng.permutation(len(x))[:2048]
    m.words = _fit_words(_residuals(m, x[some], cell[some], _sizes(m, x, cell)), _blocks(x[some]), m.eta, rng)
    return m


def encode(m: Model, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two four-bit codes per byte (rows, blocks / 2), and the size of each cell's residuals."""
    codes, sizes = [np.zeros((0, len(m.words)), np.uint8)], _sizes(m, x, cells)
    for i in range(0, len(x), 4096):
        codes.append(_choose(_residuals(m, x[i : i + 4096], cells[i : i + 4096], sizes), _blocks(x[i : i + 4096]), m.words, m.eta, 1))
    c = np.concatenate(codes)
    return c[:, 0::2] | (c[:, 1::2] << 4), sizes


def probes(m: Model, x: np.ndarray, budget: Budget = Budget()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own list, mask of the lists each row probes, similarities with the lists, which rows are in dense places)."""
    s = x @ m.centres.T
    own, k = np.argmax(s, 1), s.shape[1]
    many = min(k, max(budget.least, int(np.ceil(budget.share * k))), MAX_PROBES)
    c = _directions(m.means) @ x.T  # a row per cell: `reduceat` over short runs of columns is slow
    inside = np.empty((k, len(x)), np.float32)
    for one, cells in enumerate(np.split(c, np.searchsorted(m.cells, np.arange(1, k)))):
        cells.max(0, out=inside[one])
    inside = np.ascontiguousarray(inside.T)
    cell, row = np.divmod(np.flatnonzero(c >= DENSE), len(x))
    held = np.bincount(row, m.counts[cell], len(x))
    dense = held >= ENOUGH
    mask = (inside >= DENSE) | (~dense[:, None] & (s >= -np.partition(-s, many - 1, axis=1)[:, many - 1 : many]))
    if k > MAX_PROBES:
        best = np.maximum(s, inside)
        best[~mask] = -2
        mask &= best >= -np.partition(-best, MAX_PROBES - 1, axis=1)[:, MAX_PROBES - 1 : MAX_PROBES]
    mask[np.arange(len(x)), own] = True
    return own, mask, np.maximum(s, inside), dense


def visits(m: Model, own: np.ndarray, mask: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the regions each row asks in, `mask` without the lists of others): VISITS regions at most, the own one and
    those of the nearest probed lists."""
    n = len(m.parts)
    best = np.full((len(own), n), -2, np.float32)
    for one in range(n):
        lists = np.flatnonzero(m.regions == one)
        best[:, one] = np.where(mask[:, lists], near[:, lists], -2).max(1, initial=-2)
    best[np.arange(len(own)), m.regions[own]] = 3
    asks = best > -2
    if n > VISITS:
        asks &= best >= -np.partition(-best, VISITS - 1, axis=1)[:, VISITS - 1 : VISITS]
    return asks, mask & asks[:, m.regions]


def decode(m: Model, codes: np.ndarray, cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The vectors (float32) that codes stand for: words of the code book, brought to the size of the cell, around its mean."""
    out = np.empty((len(codes), len(m.words), WIDTH), np.float32)
    even = np.arange(0, len(m.words), 2)
    out[:, 0::2], out[:, 1::2] = m.words[even, codes & 15], m.words[even + 1, codes >> 4]
    out = out.reshape(len(codes), -1)[:, : m.means.shape[1]] * sizes[cells, None]
    out += m.means[cells]
    return out


def _batches(own: np.ndarray, dense: np.ndarray) -> list[np.ndarray]:
    """Queries that look into much the same lists: those in dense places by their nearest list, the others apart."""
    out: list[np.ndarray] = []
    for kind in (True, False):
        rows = np.flatnonzero(dense == kind)
        rows = rows[np.argsort(own[rows], kind="stable")]
        groups = np.split(rows, np.flatnonzero(np.diff(own[rows])) + 1) if kind else [rows]
        held: list[np.ndarray] = []
        for g in groups:
            held.append(g)
            n = sum(map(len, held))
            if n >= _BATCH // 2 or g is groups[-1]:
                out += [b for b in np.array_split(np.concatenate(held), max(1, -(-n // _BATCH))) if len(b)]
                held = []
    return out


def search_region(
    m: Model, x: np.ndarray, cells: np.ndarray, codes: np.ndarray, sizes: np.ndarray, q: np.ndarray, q_self: np.ndarray, q_probe: np.ndarray,
    budget: Budget = Budget(), dense: np.ndarray | None = None,
):
    """The best EXACT vectors of a region for each query: indices (-1: none) and cosines.

    x: the region's unit vectors (float64) with their cells and codes; sizes: the residual size of each cell; q: the queries
    (float64), q_self: a query's own index in x or -1; q_probe: (queries, lists) mask; dense: which queries are in dense places.

    The rows that the codes stand for are built once for all queries, so the scores of a batch with a block of rows are one matrix
    product. Rows below a query's worst kept score cost a comparison; the others are collected until `rerank` of them are chosen.
    """
    order = np.argsort(cells, kind="stable")
    lists = m.cells[cells[order]]
    used, first = np.unique(lists, return_index=True)
    ends = np.append(first[1:], len(order))

    def block(a: int, b: int):
        """Rows a to b of the order, and their lists (numbers in `used`)."""
        return np.unique(np.searchsorted(used, lists[a:b])), a, b

    # list by list for queries that look into few, and large blocks for the others
    by_list = [block(i, min(i + _BLOCK, b)) for a, b in zip(first, ends) for i in range(a, b, _BLOCK)]
    large = [block(i, min(i + _BLOCK, len(order))) for i in range(0, len(order), _BLOCK)]
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    found, score = np.full((len(q), EXACT), -1, np.int64), np.full((len(q), EXACT), -np.inf)
    if not len(used) or not len(q):
        return found, score
    near = q32 @ m.centres[used].T
    coded = decode(m, codes[order], cells[order], sizes)
    room = 2 * budget.rerank + _BLOCK
    for batch in _batches(np.argmax(near, 1), np.ones(len(q), bool) if dense is None else dense):
        n = len(batch)
        asking = q32[batch]
        best, index = np.full((n, room), -np.inf, np.float32), np.full((n, room), -1, np.int64)
        count, worst = np.zeros(n, np.int64), np.full(n, -np.inf, np.float32)
        probed = q_probe[np.ix_(batch, used)]
        ask = probed.sum(0)
        # the lists that are nearest to the batch come first, so that the worst kept score rises early
        close = np.where(ask > 0, (near[batch] * probed).sum(0) / np.maximum(ask, 1), -np.inf)

        def choose(which: np.ndarray) -> None:
            """Keep the best `rerank` candidates of some queries."""
            end = max(int(count[which].max()), budget.rerank)
            rows = which[:, None]
            keep = np.argpartition(-best[which, :end], budget.rerank - 1, axis=1)[:, : budget.rerank]
            best[which, : budget.rerank], index[which, : budget.rerank] = best[rows, keep], index[rows, keep]
            best[which, budget.rerank : end] = -np.inf
            count[which] = np.minimum(count[which], budget.rerank)
            worst[which] = best[which, : budget.rerank].min(1)  # -inf while they are fewer

        wide = 2 * (ask > 0).sum() > len(used)
        for _, a, b in sorted((b for b in (large if wide else by_list) if ask[b[0]].any()), key=lambda b: -close[b[0]].max()):
            # all queries of the batch: to copy some would cost more than to score all
            s, rows = asking @ coded[a:b].T, order[a:b]
            if not count.any():  # the first block: nothing to compare with yet
                best[:, : len(rows)], index[:, : len(rows)] = s, rows
                count[:] = len(rows)
                choose(np.arange(n))
                continue
            flat = np.flatnonzero(s >= worst[:, None])
            if not len(flat):
                continue
            c, r = np.divmod(flat, len(rows))
            r, value = rows[r], s.ravel()[flat]
            added = np.bincount(c, minlength=n)
            slot = count[c] + np.arange(len(c)) - (np.cumsum(added) - added)[c]
            best[c, slot], index[c, slot] = value, r
            count += added
            full = np.flatnonzero((count >= np.where(np.isinf(worst), 1, 2) * budget.rerank) & (added > 0))
            if len(full):
                choose(full)
        choose(np.arange(n))
        index = index[:, : budget.rerank]
        bad = (index < 0) | (index == q_self[batch, None])
        exact = np.matmul(x32[index], q32[batch][:, :, None])[:, :, 0]
        exact[bad] = -np.inf
        keep = np.argpartition(-exact, EXACT - 1, axis=1)[:, :EXACT]
        index = np.where(np.take_along_axis(bad, keep, 1), -1, np.take_along_axis(index, keep, 1))
        exact = np.einsum("nd,nrd->nr", q[batch], x[index])
        exact[index < 0] = -np.inf
        sort = np.argsort(-exact, axis=1, kind="stable")
        found[batch], score[batch] = np.take_along_axis(index, sort, 1), np.take_along_axis(exact, sort, 1)
    return found, score


def fit_models(keyed: DataFrame, fitted: Callable = fit) -> dict:
    """The models that `fitted(sample, rows)` makes, by collection; each in its own task on its bounded sample."""
    import pickle

    keyed = keyed.where(F.col("ids").isNotNull())
    counts = {r.coll_name: r["count"] for r in keyed.groupBy("coll_name").count().collect()}
    share = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, min(1.0, 0.97 * sample_rows(n) / n))]) if counts else F.lit(None)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        name = key[0].as_py()
        t = t.sort_by([("id", "ascending")])
        return pa.table({"coll_name": [name], "model": [pickle.dumps(fitted(unit(matrix(t["vec_values"])), counts[name]))]})

    if not counts:
        return {}
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    sample = keyed.where(chance < share[F.col("coll_name")]).select("coll_name", "id", "vec_values")
    rows = sample.groupBy("coll_name").applyInArrow(run, "coll_name string, model binary").collect()
    return {r.coll_name: pickle.loads(r.model) for r in rows}


_PLACED = "coll_name string, region int, member boolean, asks boolean, dense boolean, looks binary, dir_key binary, vec_values array<float>, ids array<string>"


def _first_units(m: Model) -> np.ndarray:
    """The first unit of each region."""
    return np.cumsum(m.parts * m.slices) - m.parts * m.slices


def part_of(m: Model, region: int) -> Model:
    """The model of one region: its lists and their cells, numbered from 0."""
    lists = np.flatnonzero(m.regions == region)
    cells = np.flatnonzero(m.regions[m.cells] == region)
    one = slice(region, region + 1)
    return replace(
        m, centres=m.centres[lists], cells=np.searchsorted(lists, m.cells[cells]), means=m.means[cells], counts=m.counts[cells],
        regions=np.zeros(len(lists), int), parts=m.parts[one], slices=m.slices[one],
    )


def _looks(m: Model, mask: np.ndarray, row: np.ndarray, unit_: np.ndarray) -> pa.Array:
    """For each row sent to a unit, which of the lists of the unit's region it probes, as bits."""
    region = np.searchsorted(_first_units(m), unit_, "right") - 1
    out = np.empty(len(row), object)
    for one in np.unique(region):
        here = np.flatnonzero(region == one)
        out[here] = [b.tobytes() for b in np.packbits(mask[np.ix_(row[here], np.flatnonzero(m.regions == one))], axis=1)]
    return pa.array(out, pa.binary())


def units(m: Model, home: np.ndarray, asks: np.ndarray, lot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, unit, member, asks) of all rows to send. A unit is one part and one slice of a region.

    home: each row's region; asks: mask of the regions it asks in; lot: a number of each row that chooses part and slice.
    """
    first = _first_units(m)
    row, region = np.nonzero(asks)
    own_part, own_slice = lot[row] % m.parts[region], lot[row] // 64 % m.slices[region]
    out = []
    for part in range(m.parts.max()):
        there = part < m.parts[region]
        member = there & (region == home[row]) & (own_part == part)
        for piece in range(m.slices.max()):
            here = there & (piece < m.slices[region]) & ((piece == own_slice) | member)
            i = np.flatnonzero(here)
            out.append((row[i], first[region[i]] + part * m.slices[region[i]] + piece, member[i], own_slice[i] == piece))
    return tuple(np.concatenate(c) for c in zip(*out))


def _place(models: dict[str, Model], batch: pa.RecordBatch, budget: Budget):
    """Rows of the regions: each direction at home, and as a visitor where it probes."""
    names = np.array(batch.column("coll_name").to_pylist())
    for name in sorted(set(names)):
        m = models.get(name)
        if m is None:
            continue
        part = batch.take(pa.array(np.flatnonzero(names == name)))
        values = matrix(part.column("vec_values"), np.float32)
        own, mask, near, dense = probes(m, unit(values.astype(np.float64)).astype(np.float32), budget)
        asked, mask = visits(m, own, mask, near)
        # drawn from the row alone, so a task that runs again places it alike
        lot = (np.ascontiguousarray(values).view(np.uint32).astype(np.uint64).sum(1) * np.uint64(0x9E3779B1) >> np.uint64(12)).astype(np.int64)
        row, unit_, member, asks = units(m, m.regions[own], asked, lot)
        take, at_home = pa.array(row), pa.array(row, mask=~member)  # visitors bring no ids
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(row), pa.string()),
                pa.array(unit_.astype(np.int32)),
                pa.array(member),
                pa.array(asks),
                pa.array(dense[row]),
                _looks(m, mask, row, unit_),
                part.column("dir_key").take(take),
                part.column("vec_values").take(take),
                part.column("ids").take(at_home),
            ],
            names=["coll_name", "region", "member", "asks", "dense", "looks", "dir_key", "vec_values", "ids"],
        )


_FOUND = "coll_name string, dir_key binary, near array<struct<far:int,id:string>>"


def _find(m: Model, t: pa.Table, budget: Budget) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of a unit: which are its members, which ask, each asking row's number among the members (-1: a
    visitor), and for each the nearest members and their cosines."""
    x = unit(matrix(t["vec_values"]))
    home = np.flatnonzero(t["member"].to_numpy(zero_copy_only=False))
    asks = np.flatnonzero(t["asks"].to_numpy(zero_copy_only=False))
    number = np.full(len(x), -1)
    number[home] = np.arange(len(home))
    if not len(home) or not len(asks):
        return home, asks, number[asks], np.full((len(asks), 1), -1), np.full((len(asks), 1), -np.inf)
    # what a row probes was found when it was sent: here only the region's own lists count, however many the collection has
    m = part_of(m, int(np.searchsorted(_first_units(m), t["region"][0].as_py(), "right")) - 1)
    x32 = x[home].astype(np.float32)
    own = _nearest(x32, m.centres)
    cells = cell_of(m, x32, own)
    codes, sizes = encode(m, x32, cells)
    q = x[asks]
    bits = np.frombuffer(b"".join(t["looks"].take(pa.array(asks)).to_pylist()), np.uint8).reshape(len(asks), -1)
    mask = np.unpackbits(bits, axis=1, count=len(m.centres)).astype(bool)
    dense = t["dense"].to_numpy(zero_copy_only=False)[asks]
    found, score = search_region(m, x[home], cells, codes, sizes, q, number[asks], mask, budget, dense)
    return home, asks, number[asks], found, np.round(score, 6)


def _near_table(name: str, t: pa.Table, home: np.ndarray, asks: np.ndarray, q_self: np.ndarray, found: np.ndarray, score: np.ndarray, keep: int) -> pa.Table:
    ids = t["ids"].combine_chunks().take(pa.array(home))
    # a member also has its own copies; more than `keep` directions can't be needed but for ties
    score = np.concatenate([np.ones((len(asks), 1)), score], 1)
    found = np.concatenate([q_self[:, None], found], 1)
    good = (found >= 0) & (score >= score[:, min(keep, score.shape[1] - 1)][:, None])
    row, _ = np.nonzero(good)
    lists = ids.take(pa.array(found[good]))
    lens = np.asarray(lists.value_lengths())
    far = np.repeat(np.round(-1e6 * score[good]).astype(np.int32), lens)
    per_row = np.bincount(row, lens, len(asks)).astype(np.int64)
    near = pa.StructArray.from_arrays([pa.array(far), lists.flatten()], names=["far", "id"])
    offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.table({"coll_name": pa.array([name] * len(asks), pa.string()), "dir_key": t["dir_key"].take(pa.array(asks)), "near": pa.ListArray.from_arrays(pa.array(offsets), near)})


def placed_directions(keyed: DataFrame, models, budget: Budget = Budget()) -> DataFrame:
    """The rows of all units. `models`: the broadcast models."""

    def place(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                yield from _place(models.value, b.slice(i, 2048), budget)

    heads = keyed.where(F.col("ids").isNotNull())
    return heads.select("coll_name", "vec_values", "dir_key", "ids").mapInArrow(place, _PLACED)


def nearest_directions(keyed: DataFrame, k: int = 5) -> DataFrame:
    """coll_name, dir_key, near: for each direction the k + 1 nearest ids, its own included, as (far, id):
    the negative cosine in millionths, and the id. If `keyed` was made with `keep` of 1, an id stands for its
    direction, else at most `keep` ids of a direction are listed.
    """

    budget = Budget()
    models = keyed.sparkSession.sparkContext.broadcast(fit_models(keyed))

    def search(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        name, t = key[0].as_py(), t.combine_chunks()
        return _near_table(name, t, *_find(models.value[name], t, budget), k + 1)

    found = placed_directions(keyed, models, budget).groupBy("coll_name", "region").applyInArrow(search, _FOUND)
    merged = found.groupBy("coll_name", "dir_key").agg(F.flatten(F.collect_list("near")).alias("near"))
    return merged.select("coll_name", "dir_key", F.slice(F.array_sort("near"), 1, k + 1).alias("near"))


def most_similar(usable: DataFrame, k: int = 5) -> DataFrame:
    """coll_name, id, rank (from 1), near_id, similarity (6 decimals): the k most similar of every vector."""
    keyed = cut(directions(usable.select("coll_name", "id", "vec_values"), k + 1))
    lists = nearest_directions(keyed, k)
    rows = keyed.select("coll_name", "id", "dir_key").join(lists, ["coll_name", "dir_key"])
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)
    rows = rows.select("coll_name", "id", F.posexplode(others).alias("_at", "_n"))
    return rows.select(
        "coll_name", "id", (F.col("_at") + 1).alias("rank"), F.col("_n.id").alias("near_id"), (F.col("_n.far") / -1e6).alias("similarity")
    )


def similar_pairs(usable: DataFrame, k: int = 5, least: float = 0.85) -> DataFrame:
    """coll_name, id_a, id_b (id_a < id_b): pairs of similarity `least` or more of which one is among the k of the other."""
    near = most_similar(usable, k).where(F.col("similarity") >= least)
    a, b = F.col("id"), F.col("near_id")
    return near.select("coll_name", F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()
