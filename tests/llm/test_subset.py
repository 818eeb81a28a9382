import numpy as np

from sparvex.llm import subset as S
from sparvex.llm.subset import lazy_greedy, varied_subsets
from sparvex.llm.vectors import unit, usable_vectors

from .test_ann import CONFIG, VECTORS, rows_of

REQUESTS = "request_id bigint, coll_name string, subset_size int, vary_by string"


def plain_greedy(x, size):
    cover = np.minimum(np.maximum(x @ x.T, 0), S.ENOUGH) / S.ENOUGH
    best, chosen = np.zeros(len(x)), []
    for _ in range(size):
        gains = np.maximum(cover - best, 0).sum(1)
        gains[chosen] = -1
        chosen.append(int(np.argmax(gains)))
        best = np.maximum(best, cover[chosen[-1]])
    return best.sum()


def test_lazy_equals_plain_greedy():
    x = unit(np.random.default_rng(0).normal(size=(80, 8)))
    chosen, _ = lazy_greedy(x, np.ones(80), np.full(80, -1), 10)
    cover = np.minimum(np.maximum(x @ x.T, 0), S.ENOUGH) / S.ENOUGH
    assert abs(cover[chosen].max(0).sum() - plain_greedy(x, 10)) < 1e-3


def test_two_rounds_cover_the_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 64)
    rng = np.random.default_rng(2)
    sizes = [200, 40, 30, 10, 10, 5]
    x = np.concatenate([0.02 * rng.normal(size=(n, 16)) + rng.normal(size=16) for n in sizes])
    group = np.repeat(np.arange(len(sizes)), sizes)
    rows = [(*r[:3], '{"kind": "%s"}' % ("a", "B ", "b")[i % 3] if i else None, *r[4:]) for i, r in enumerate(rows_of(x))]
    usable = usable_vectors(spark.createDataFrame(rows, VECTORS), spark.createDataFrame([("c", 16)], CONFIG))
    asked = [(1, "c", 6, None), (1, "c", 6, None), (2, "c", 6, "kind"), (3, "c", None, None), (4, None, 3, None), (5, "c", 0, None), (6, "none", 2, None)]
    got = varied_subsets(usable, spark.createDataFrame(asked, REQUESTS)).collect()
    picks = {q: [int(r.id[1:]) for r in got if r.request_id == q] for q in (1, 2)}
    assert {r.request_id for r in got} == {1, 2} and len(got) == 12
    assert sorted(group[picks[1]]) == [0, 1, 2, 3, 4, 5]
    assert len({rows[i][3] and rows[i][3].lower().replace(" ", "") for i in picks[2]}) >= 2
    u = unit(x)
    cover = np.minimum(np.maximum(u @ u.T, 0), S.ENOUGH) / S.ENOUGH
    assert cover[picks[1]].max(0).sum() >= 0.95 * plain_greedy(u, 6)


def test_copies_fill_up(spark):
    rows = rows_of([[1.0, 2.0]] * 4 + [[2.0, -1.0]])
    usable = usable_vectors(spark.createDataFrame(rows, VECTORS), spark.createDataFrame([("c", 2)], CONFIG))
    requests = spark.createDataFrame([(1, "c", 4, "x"), (2, "c", 99, None)], REQUESTS)
    got = [(r.request_id, r.id) for r in varied_subsets(usable, requests).orderBy("request_id", "rank").collect()]
    assert got[:4] == [(1, "v0000"), (1, "v0004"), (1, "v0001"), (1, "v0002")]
    assert sorted(i for q, i in got if q == 2) == ["v0000", "v0001", "v0002", "v0003", "v0004"]
    assert varied_subsets(usable.limit(0), requests).count() == 0


def test_large_subsets_end(spark):
    """Half of the vectors are asked for: more than half of a part."""
    x = np.random.default_rng(4).normal(size=(7000, 8))
    usable = usable_vectors(spark.createDataFrame(rows_of(x), VECTORS), spark.createDataFrame([("c", 8)], CONFIG))
    requests = spark.createDataFrame([(1, "c", 3500, None), (2, "c", 10, None)], REQUESTS)
    got = varied_subsets(usable, requests).collect()
    picks = {q: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.request_id == q] for q in (1, 2)}
    assert len(set(picks[1])) == 3500 and picks[2] == picks[1][:10]


def test_values_that_only_copies_hold(spark):
    rows = [(*r[:3], '{"kind": "%s"}' % k, *r[4:]) for r, k in zip(rows_of([[1.0, 2.0]] * 3 + [[2.0, -1.0]]), "aaba")]
    usable = usable_vectors(spark.createDataFrame(rows, VECTORS), spark.createDataFrame([("c", 2)], CONFIG))
    got = varied_subsets(usable, spark.createDataFrame([(1, "c", 3, "kind")], REQUESTS)).collect()
    assert {r.id for r in got} == {"v0000", "v0002", "v0003"}
