import numpy as np
import pytest

from sparvex.llm.ann import cell_of, encode, fit, most_similar, probes, search_region, similar_pairs
from sparvex.llm.vectors import unit, usable_vectors

VECTORS = "coll_name string, id string, vec_values array<float>, metadata string, vec_version bigint, vec_ts bigint, exported_at timestamp, dir_key string"
CONFIG = "coll_name string, dim int"


def rows_of(x, name="c", prefix="v"):
    return [(name, f"{prefix}{i:04d}", [float(e) for e in v], None, 1, 1, None, "clash") for i, v in enumerate(x)]


def brute(x, k):
    x = unit(np.asarray(x, np.float32).astype(float))
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    return [[j for j in np.lexsort((np.arange(len(s)), -s[i]))[:k]] for i in range(len(s))], s


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    return np.concatenate([c + 0.15 * rng.normal(size=(40, 16)) for c in centres] + [rng.normal(size=(200, 16))])


def test_recall_against_brute_force(spark, groups):
    usable = usable_vectors(spark.createDataFrame(rows_of(groups), VECTORS), spark.createDataFrame([("c", 16)], CONFIG))
    got = {}
    for r in most_similar(usable, 5).collect():
        got.setdefault(r.id, []).append((r["rank"], r.near_id))
    want, _ = brute(groups, 5)
    hits = sum(len({f"v{j:04d}" for j in w} & {n for _, n in got[f"v{i:04d}"]}) for i, w in enumerate(want))
    assert hits / (5 * len(want)) >= 0.9
    assert all(sorted(r for r, _ in v) == [1, 2, 3, 4, 5] for v in got.values())


def test_score_aware_codes_keep_the_parallel_error_small(groups):
    x = unit(groups).astype(np.float32)
    m = fit(x, len(x))
    own, mask, *_ = probes(m, x)
    cells = cell_of(m, x, own)
    codes, sizes = encode(m, x, cells)
    words = np.empty((len(x), codes.shape[1] * 2), np.uint8)
    words[:, 0::2], words[:, 1::2] = codes & 15, codes >> 4
    error = x - m.means[cells] - m.words[np.arange(words.shape[1]), words].reshape(len(x), -1)[:, :16] * sizes[cells, None]
    along, all_ = (error * x).sum(1), (error**2).sum(1)
    assert (along**2).mean() < all_.mean() / 16
    found, score = search_region(m, x.astype(float), cells, codes, sizes, x.astype(float), np.arange(len(x)), mask)
    assert (np.diff(score, axis=1)[np.isfinite(score[:, 1:])] <= 1e-9).all() and not (found == np.arange(len(x))[:, None]).any()


def test_copies_ties_and_dirty_rows(spark):
    same = [[1.0, 2.0, 3.0, 4.0]] * 9 + [[2.0, 4.0, 6.0, 8.0]] * 3
    rows = rows_of(same) + rows_of([[0.0, 0.0, 1.0, -1.0]], prefix="w")
    rows += [("c", "n1", None, None, 1, 1, None, ""), ("c", "n2", [1.0], None, 1, 1, None, ""), ("c", "n3", [0.0] * 4, None, 1, 1, None, "")]
    rows += [("c", "n4", [float("nan")] * 4, "{", 1, 1, None, ""), ("c", "n5", [float("inf"), 1.0, 1.0, 1.0], None, 1, 1, None, "")]
    rows += [("c", "n6", [None, 1.0, 1.0, 1.0], None, 1, 1, None, ""), ("x", "n7", [1.0] * 4, None, 1, 1, None, ""), (None, "n8", [1.0] * 4, None, 1, 1, None, "")]
    rows += [("c", "v0000", [9.0, -9.0, 0.0, 0.0], None, 0, 1, None, "older")] + rows[:2] + [("d", "alone", [1.0, 1.0], None, None, None, None, "")]
    vectors, config = spark.createDataFrame(rows, VECTORS), spark.createDataFrame([("c", 4), ("d", 2), (None, None)], CONFIG)
    usable = usable_vectors(vectors, config)
    assert {r.id for r in usable.collect()} == {f"v{i:04d}" for i in range(12)} | {"w0000", "alone"}
    near = {}
    for r in most_similar(usable, 5).collect():
        near.setdefault(r.id, []).append((r["rank"], r.near_id, r.similarity))
    assert [i for _, i, _ in sorted(near["v0008"])] == [f"v{i:04d}" for i in range(5)]
    assert [i for _, i, _ in sorted(near["v0002"])] == ["v0000", "v0001", "v0003", "v0004", "v0005"]
    assert "alone" not in near
    pairs = {(r.id_a, r.id_b) for r in similar_pairs(usable).collect()}
    ids = [f"v{i:04d}" for i in range(12)]
    assert pairs == {(a, b) for a in ids[:6] for b in ids if a < b and (a in ids[:5] or False)} | {(ids[i], ids[5]) for i in range(5)}
    assert most_similar(usable.limit(0)).count() == 0


def test_large_lists_are_split(groups, monkeypatch):
    import pyarrow as pa

    from sparvex.llm import ann

    monkeypatch.setattr(ann, "REGION_ROWS", 100)
    monkeypatch.setattr(ann, "LIST_ROWS", 500)
    x = unit(groups)
    m = fit(x, len(x))
    assert m.parts.max() > 1
    ids = [f"v{i:04d}" for i in range(len(x))]
    batch = pa.RecordBatch.from_pydict({
        "coll_name": ["c"] * len(x), "id": ids, "dir_key": [i.encode() for i in ids], "ids": [[i] for i in ids],
        "vec_values": pa.array(x.tolist(), pa.list_(pa.float32())),
    })
    placed = pa.Table.from_batches(list(ann._place({"c": m, "x": m}, batch, ann.Budget())))
    regions = np.array(placed["region"])
    assert len(np.unique(regions)) == (m.parts * m.slices).sum() and m.slices.max() > 1
    member, asks = (np.array(placed[c].to_pylist()) for c in ("member", "asks"))
    assert (member & asks).sum() == len(x) and np.bincount(regions).max() <= 6 * 100
    near = {i: [] for i in ids}
    for r in np.unique(regions):
        t = placed.take(pa.array(np.flatnonzero(regions == r))).combine_chunks()
        home, asking, _, found, score = ann._find(m, t, ann.Budget())
        names = [k.decode() for k in t["dir_key"].to_pylist()]
        for q, f, s in zip(asking.tolist(), found, score):
            near[names[q]] += [(-v, names[home[j]]) for j, v in zip(f, s) if j >= 0]
    want, _ = brute(groups, 5)
    hits = sum(len({ids[j] for j in w} & {n for _, n in sorted(near[ids[i]])[:5]}) for i, w in enumerate(want))
    assert hits / (5 * len(want)) >= 0.9


@pytest.mark.parametrize("spread", [True, False])
def test_sent_rows_do_not_grow_with_the_collection(spread):
    """Sent copies and rows of a unit, from a model fitted for 1,000,000 vectors; the share of a sample stands for the rest."""
    from sparvex.llm import ann

    rng = np.random.default_rng(1)
    rows, dim = 1_000_000, 32
    draw = lambda n: rng.normal(size=(n, dim)) if spread else rng.normal(size=(200, dim))[rng.integers(0, 200, n)] + 0.4 * rng.normal(size=(n, dim))
    x = unit(draw(ann.sample_rows(rows) // 4))
    m = ann.fit(x, rows)
    y = unit(draw(4000)).astype(np.float32)
    own, mask, near, _ = ann.probes(m, y)
    row, unit_, member, asks = ann.units(m, m.regions[own], ann.visits(m, own, mask, near)[0], rng.integers(0, 2**40, len(y)))
    assert np.bincount(row[asks], minlength=len(y)).max() <= ann.VISITS * m.parts.max()
    assert len(row) / len(y) <= 4.5
    assert np.bincount(unit_).mean() * rows / len(y) <= 50_000


def test_recall_over_given_vectors(spark):
    """Of all vectors, and of those without a near one, against brute force."""
    from sparvex.llm.vectors import matrix
    from sparvex.runtime import table

    sf = "/root/testdata/sf0.01"
    usable = usable_vectors(table(spark, sf, "vectors"), table(spark, sf, "coll_config")).select("coll_name", "id", "vec_values")
    near = {}
    for r in most_similar(usable, 5).collect():
        near.setdefault((r.coll_name, r.id), set()).add(r.near_id)
    got, groups = usable.toArrow().combine_chunks(), {}
    for i, c in enumerate(got["coll_name"].to_pylist()):
        groups.setdefault(c, []).append(i)
    hits, alone = [], []
    for c, rows in groups.items():
        part = got.take(rows)
        ids, x = np.array(part["id"].to_pylist()), unit(matrix(part["vec_values"]))
        by_id = np.argsort(ids)
        ids, x = ids[by_id], x[by_id]
        s = np.round(x @ x.T, 6)
        np.fill_diagonal(s, -2)
        for i, best in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :5]):
            hits.append(len(near[c, ids[i]] & set(ids[best])) / min(5, len(ids) - 1))
            alone.append(s[i].max() < 0.85)
    hits, alone = np.array(hits), np.array(alone)
    assert hits.mean() >= 0.95 and hits[alone].mean() >= 0.9 and hits[~alone].mean() >= 0.99


def cost():
    """CPU seconds of coding a region and searching it for all its members, and of comparing all with all exactly."""
    import time

    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(4000, 64)))
    x32 = x.astype(np.float32)
    m = fit(x, len(x))
    own, mask, _, dense = probes(m, x32)
    cells = cell_of(m, x32, own)

    def search():
        codes, sizes = encode(m, x32, cells)
        search_region(m, x, cells, codes, sizes, x, np.arange(len(x)), mask, dense=dense)

    def plain():
        for i in range(0, len(x), 128):
            np.argpartition(-(x32[i : i + 128] @ x32.T), 96, axis=1)

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    return min(seconds(search) for _ in range(4)), min(seconds(plain) for _ in range(4))


def test_cost_of_coding_and_search():
    import os
    import subprocess
    import sys

    # one thread, as in a task
    one = os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
    said = subprocess.run([sys.executable, "-c", "from tests.llm.test_ann import cost; print(*cost())"], env=one, capture_output=True, text=True, check=True, timeout=120)
    search, plain = map(float, said.stdout.split())
    assert search <= 6 * plain


def test_codes_of_one_dimension_are_those_of_the_general_loss():
    from sparvex.llm.ann import _choose

    rng = np.random.default_rng(6)
    r, u, words = rng.normal(size=(500, 12, 1)), unit(rng.normal(size=(500, 12)))[:, :, None], rng.normal(size=(12, 16, 1))
    flat = [np.concatenate([a, np.zeros_like(a)], 2) for a in (r, u, words)]  # a second dimension that says nothing
    for passes in (0, 1, 3):
        assert (_choose(r, u, words, 16.0, passes) == _choose(*flat, 16.0, passes)).all()


def test_scores_are_products_with_the_decoded_rows(groups):
    """The candidates of a search are those that the codes alone put first."""
    from sparvex.llm.ann import EXACT, Budget, decode

    x = unit(groups)
    x32 = x.astype(np.float32)
    m = fit(x, len(x))
    cells = cell_of(m, x32, probes(m, x32)[0])
    codes, sizes = encode(m, x32, cells)
    rows = decode(m, codes, cells, sizes)
    assert np.linalg.norm(rows - x32, axis=1).mean() < 0.1
    few = Budget(rerank=EXACT)
    found, _ = search_region(m, x, cells, codes, sizes, x, np.full(len(x), -1), np.ones((len(x), len(m.centres)), bool), few)
    want = np.argsort(-(x32 @ rows.T), axis=1)[:, :EXACT]
    assert np.mean([len(set(f) & set(w)) for f, w in zip(found, want)]) >= EXACT - 0.01


def test_a_region_needs_only_its_own_lists(groups, monkeypatch):
    """What a row probes comes with it, so the work of a region does not grow with the lists of the collection."""
    import pyarrow as pa

    from sparvex.llm import ann

    monkeypatch.setattr(ann, "REGION_ROWS", 200)
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    x = unit(groups)
    m = fit(x, len(x))
    ids = [f"v{i:04d}" for i in range(len(x))]
    batch = pa.RecordBatch.from_pydict({
        "coll_name": ["c"] * len(x), "id": ids, "dir_key": [i.encode() for i in ids], "ids": [[i] for i in ids],
        "vec_values": pa.array(x.tolist(), pa.list_(pa.float32())),
    })
    x32 = unit(x.astype(np.float32).astype(float)).astype(np.float32)
    own, mask, near, dense = probes(m, x32)
    mask = ann.visits(m, own, mask, near)[1]
    placed = pa.Table.from_batches(list(ann._place({"c": m}, batch, ann.Budget())))
    regions, seen = np.array(placed["region"]), np.zeros_like(mask)

    def no_more(*_):
        raise AssertionError("probed again")

    def checked(part, x_, cells, codes, sizes, q, q_self, q_probe, budget, flags):
        asked = np.argmax(q.astype(np.float32) @ x32.T, 1)
        lists = np.flatnonzero(m.regions == region)
        assert np.allclose(part.centres, m.centres[lists]) and (flags == dense[asked]).all()
        seen[np.ix_(asked, lists)] |= q_probe
        return search_region(part, x_, cells, codes, sizes, q, q_self, q_probe, budget, flags)

    monkeypatch.setattr(ann, "probes", no_more)
    monkeypatch.setattr(ann, "search_region", checked)
    first = np.cumsum(m.parts * m.slices) - m.parts * m.slices
    assert len(m.parts) > 2
    for r in np.unique(regions):
        region = int(np.searchsorted(first, r, "right")) - 1
        ann._find(m, placed.take(pa.array(np.flatnonzero(regions == r))).combine_chunks(), ann.Budget())
    assert (seen == mask).all()
