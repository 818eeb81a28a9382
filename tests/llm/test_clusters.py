import random

import numpy as np

from sparvex.llm import clusters as C
from sparvex.llm.vectors import unit, usable_vectors

from .test_ann import CONFIG, VECTORS, rows_of


def union(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


def test_boruvka_equals_kruskal(spark, monkeypatch):
    monkeypatch.setattr(C, "LAST_EDGES", 0)  # all rounds distributed
    random.seed(5)
    edges = {tuple(sorted(random.sample(range(60), 2))): random.randint(1, 9) / 10 for _ in range(90)}
    rows = [("c", f"{a:02d}", f"{b:02d}", w) for (a, b), w in edges.items()] + [("d", "x", "y", 0.5)]
    forest, labels = C.spanning_forest(C.thin(spark.createDataFrame(rows, C._EDGES)))
    want = union((a, b) for c, a, b, _ in rows if c == "c")
    assert {(r.coll_name, r.node): r.label for r in labels.collect()} == {("c", k): v for k, v in want.items()} | {("d", "x"): "x", ("d", "y"): "x"}
    got, parent, total = forest.collect(), {}, 0

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, a, b, w in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    assert len(got) == len(want) + 2 - len(set(want.values())) - 1
    assert abs(sum(r.length for r in got) - total) < 1e-9


def test_groups_and_clusters(spark):
    rng = np.random.default_rng(1)
    near = [0.02 * rng.normal(size=(n, 16)) + rng.normal(size=16) for n in (30, 12, 6)]
    x = np.concatenate([*near, near[0][:1], 3 * near[1][:1], rng.normal(size=(20, 16))])
    rows = [(*r[:3], '{"category": " Arts"}' if i % 3 else '{"category": "arts", "x": 1', *r[4:]) for i, r in enumerate(rows_of(x))]
    rows.append(("c", "bad", None, None, 1, 1, None, ""))
    usable = usable_vectors(spark.createDataFrame(rows, VECTORS), spark.createDataFrame([("c", 16)], CONFIG))
    u = unit(np.asarray(x, np.float32).astype(float))
    i, j = np.nonzero(np.triu(u @ u.T >= 0.85, 1))
    want = {f"v{k:04d}": f"v{v:04d}" for k, v in union(zip(i.tolist(), j.tolist())).items()}
    assert {r.id: r.first_id for r in C.similarity_groups(usable).collect()} == want
    members, described = C.clusters(usable)
    got = {r.cluster: r for r in described.collect()}
    assert sorted(r["size"] for r in got.values()) == [6, 13, 31]
    assert all(len(r.exemplars) == 3 and r.usual["category"] == "arts" for r in got.values())
    assert {r.id: r.cluster for r in members.collect()} == want
    assert C.similarity_groups(usable.limit(0)).count() == 0
    assert C.clusters(usable.limit(0))[1].count() == 0


def test_arcs_that_meet_beyond_their_nearest(spark):
    """Two tight arcs whose links are in nobody's nearest: one group."""
    turn = lambda t, z: [np.cos(t), np.sin(t), z, 0.0]
    x = np.array([turn(0.002 * i, 0.0) for i in range(20)] + [turn(0.002 * i, 0.55) for i in range(20)])
    usable = usable_vectors(spark.createDataFrame(rows_of(x), VECTORS), spark.createDataFrame([("c", 4)], CONFIG))
    assert {r.first_id for r in C.similarity_groups(usable).collect()} == {"v0000"}


def plain_clusters(x, weight, min_size, min_samples, least):
    """The method on one machine, all distances at once: the nodes of each chosen cluster."""
    n = len(x)
    d = np.round(1 - x @ x.T, 6)
    core = np.empty(n)
    for i in range(n):
        own = sorted((0.0 if j == i else d[i, j], j) for j in range(n) for _ in range(weight[j] - (j == i)))
        core[i] = own[min_samples - 2][0] if len(own) > min_samples - 2 else 9
    m = np.round(np.maximum(d, np.maximum(core[:, None], core[None])), 6)
    clusters, above = [], {}

    def down(nodes, top):  # top: the length at which this set comes into being, from above
        lengths = sorted({m[i, j] for i in nodes for j in nodes if i < j}, reverse=True)
        me = {"nodes": set(nodes), "kids": [], "own": 0.0}
        rest = list(nodes)
        for w in lengths:
            parts, left = [], set(rest)
            while left:
                todo, part = [min(left)], set()
                while todo:
                    i = todo.pop()
                    if i in part:
                        continue
                    part.add(i)
                    todo += [j for j in left if j not in part and m[i, j] < w]
                left -= part
                parts.append(part)
            big = [p for p in parts if sum(weight[i] for i in p) >= min_size]
            gone = [i for p in parts if p not in big for i in p]
            me["own"] += sum(weight[i] for i in gone) * (1 / max(w, 1e-6) - 1 / top)
            if len(big) > 1:
                me["own"] += sum(weight[i] for p in big for i in p) * (1 / max(w, 1e-6) - 1 / top)
                me["kids"] = [down(sorted(p), max(w, 1e-6)) for p in big]
                rest = []
                break
            rest = sorted(big[0]) if big else []
            if not rest:
                break
        me["own"] += sum(weight[i] for i in rest) * (1 / 1e-6 - 1 / top)
        below = sum(k["best"] for k in me["kids"])
        me["wins"], me["best"] = me["own"] >= below, max(me["own"], below)
        return me

    def pick(c):
        if c["wins"]:
            clusters.append(frozenset(c["nodes"]))
        else:
            for k in c["kids"]:
                pick(k)

    left = set(range(n))
    while left:
        todo, part = [min(left)], set()
        while todo:
            i = todo.pop()
            if i not in part:
                part.add(i)
                todo += [j for j in left if j not in part and m[i, j] <= round(1 - least, 6)]
        left -= part
        if sum(weight[i] for i in part) >= min_size:
            pick(down(sorted(part), 1 - least))
    return set(clusters)


def test_stable_clusters_equal_the_method_on_one_machine(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = [c + 0.25 * rng.normal(size=12) for c in 1.0 * rng.normal(size=(4, 12)) for _ in range(3)]
    x = np.concatenate([c + s * rng.normal(size=(n, 12)) for c, s, n in zip(centres, [0.02, 0.05, 0.1] * 4, [9, 14, 25, 6, 30, 8, 5, 5, 12, 40, 7, 9])])
    x = np.concatenate([x, x[:3], x[:3], x[50:52] * 2, rng.normal(size=(30, 12)), [[9.0] + [0.0] * 11] * 6])
    usable = usable_vectors(spark.createDataFrame(rows_of(x), VECTORS), spark.createDataFrame([("c", 12)], CONFIG))
    keyed = C.cut(C.directions(usable.select("coll_name", "id", "vec_values"), 1))
    all_ = C.nodes(keyed).drop("dir_key").collect()
    number = {r.node: i for i, r in enumerate(sorted(all_, key=lambda r: r.node))}
    names = sorted(number)
    u, weight = unit(np.asarray(x, np.float32).astype(float))[[int(i[1:]) for i in names]], [r.weight for r in sorted(all_, key=lambda r: r.node)]
    want = {frozenset(names[i] for i in c) for c in plain_clusters(u, weight, 5, 3, 0.85)}
    assert len(want) >= 6
    forest, labels = map(C.cut, C.density_forest(keyed, 0.85, 3))
    weights = C.nodes(keyed).drop("dir_key")
    for band_edges in (None, 25):  # at once, and the large components in bands
        got = {}
        for r in C.stable_clusters(forest, labels, weights, 0.85, 5, band_edges).collect():
            got.setdefault(r.cluster, set()).add(r.node)
        assert {frozenset(c) for c in got.values()} == want
    monkeypatch.setattr(C, "LAST_EDGES", 0)  # all Boruvka rounds distributed: the same components and lengths
    other, parts = C.density_forest(keyed, 0.85, 3)
    assert sorted(r.length for r in other.collect()) == sorted(r.length for r in forest.collect())
    assert set(map(tuple, parts.collect())) == set(map(tuple, labels.collect()))


def test_no_link_is_lost_between_lists(spark):
    """Isolated pairs at 0.85 to 0.93 among spread vectors, in many lists."""
    rng = np.random.default_rng(3)
    one = unit(rng.normal(size=(1500, 64)))
    other = rng.normal(size=one.shape)
    other = unit(other - (other * one).sum(1, keepdims=True) * one)
    cosine = rng.uniform(0.851, 0.93, (len(one), 1))
    groups = unit(np.repeat(rng.normal(size=(2, 64)), 700, axis=0) + 0.3 * rng.normal(size=(1400, 64)))
    x = rng.permutation(np.concatenate([one, cosine * one + np.sqrt(1 - cosine**2) * other, groups, rng.normal(size=(2000, 64))]))
    usable = usable_vectors(spark.createDataFrame(rows_of(x), VECTORS), spark.createDataFrame([("c", 64)], CONFIG))
    u = unit(np.asarray(x, np.float32).astype(float))
    i, j = np.nonzero(np.triu(u @ u.T >= 0.85, 1))
    want = {f"v{k:04d}": f"v{v:04d}" for k, v in union(zip(i.tolist(), j.tolist())).items()}
    assert {r.id: r.first_id for r in C.similarity_groups(usable).collect()} == want


def test_copies_count_in_core_distances(spark):
    """A has many copies and B, at 0.1, no third neighbour; of C, D and E only D has one copy."""

    def at(cosine, i, j):
        v = np.zeros(8)
        v[i], v[j] = cosine, np.sqrt(1 - cosine**2)
        return v

    a, b = at(1.0, 0, 1), at(0.9, 0, 1)
    c, d, e = at(1.0, 2, 3), at(0.95, 2, 3), at(0.8, 2, 4)
    x = np.stack([*[a] * 6, b, c, d, 2 * d, e])
    usable = usable_vectors(spark.createDataFrame(rows_of(x), VECTORS), spark.createDataFrame([("c", 8)], CONFIG))
    keyed = C.cut(C.directions(usable.select("coll_name", "id", "vec_values"), 1))
    got = {(r.a, r.b): r.length for r in C.density_forest(keyed, 0.7, 3)[0].collect()}
    assert got.pop(("v0000", "v0006")) == 0.1 and got.pop(("v0007", "v0008")) == 0.05
    assert set(got) <= {("v0007", "v0010"), ("v0008", "v0010")} and list(got.values()) == [0.24]
    assert {r.cluster: r["size"] for r in C.clusters(usable, min_size=5, least=0.7)[1].collect()} == {"v0000": 7}
