import json
import random

from sparvex.operators.changefeed import apply_patches, compose_patches, current_state
from sparvex.operators.history import attribute_history, attribute_intervals, canonical_attributes

OBS = "obs_id bigint, coll_name string, id string, vec_version bigint, vec_ts bigint, metadata string, valid_from string, attrs string"
S = 1_700_000_000


def observations(rows):
    return [(n, "c", *r, "clash", None) for n, r in enumerate(rows)]


def history(spark, rows, **options):
    h = attribute_history(spark.createDataFrame(observations(rows), OBS), **options)
    return sorted((r.id, r.valid_from, r.valid_to, json.dumps(r.attrs, sort_keys=True)) for r in h.collect())


def test_history_rules(spark):
    ns = lambda s: (S + s) * 10**9
    rows = [
        ("a", 1, S, '{"x": 1, "y": {"p": [1, 2.0], "q": null}}'), ("a", 2, (S + 1) * 1000, '{ "y": {"q":null,"p":[1.0,2]}, "x": 10e-1 }'), ("a", 3, (S + 2) * 10**6, None),
        ("a", 4, ns(3), '{"x": 2}'), ("a", 4, ns(3), '{"x": 2.0}'), ("a", 3, ns(3), '{"x": 3}'), ("a", 5, ns(4), '{"x": 2'), ("a", 6, ns(5), "[]"), ("a", None, ns(3), '{"x": 4}'),
        ("a", 7, ns(6), '{"x": 1, "y": {"p": [1, 2], "q": null}}'), ("a", 8, None, '{"x": 9}'), ("b", 1, S, None), ("b", 1, ns(9), "{}"), ("b", 1, ns(10), "null"), (None, 1, S, "{}"),
    ]
    got = history(spark, rows)
    assert [(i, f - ns(0), t if t < 0 else t - ns(0)) for i, f, t, _ in got] == [("a", 0, 3 * 10**9), ("a", 3 * 10**9, 6 * 10**9), ("a", 6 * 10**9, -1), ("b", 9 * 10**9, -1)]
    assert got[3][3] == "{}" and json.loads(got[1][3]) == {"x": "2"}
    assert history(spark, []) == []
    assert [r[1] - ns(0) for r in history(spark, rows, attributes=["y"]) if r[0] == "a"] == [0, 3 * 10**9, 6 * 10**9]


def test_history_equals_brute_force_with_a_hot_entity(spark):
    random.seed(4)
    rows = []
    for n in range(1500):
        id = "hot" if random.random() < 0.5 else f"v{random.randint(0, 30)}"
        meta = random.choice([None, "{}", '{"a": 1}', '{"a": 1.0}', '{"b": 2, "a": 1}', '{"a": 1, "b": 2}', '{"b": "x"}', "{bad"])
        rows.append((id, random.randint(1, 3), (S + random.randint(0, 900_000)) * 10**9, meta))
    rows += random.sample(rows, 200)
    seen = {}
    for id, v, t, m in rows:
        if m == "{bad":
            continue
        best = seen.setdefault(id, {})
        rank = (v, m is not None, json.dumps([{"key": k, "value": x} for k, x in canonical_attributes(m) or []], separators=(",", ":")) if m else "")
        if t not in best or rank > best[t][0]:
            best[t] = (rank, m)
    want = set()
    for id, best in seen.items():
        state, starts = None, []
        for t in sorted(best):
            m = best[t][1]
            if m is not None and json.loads(m) != state:
                state = json.loads(m)
                starts.append((t, state))
        for i, (t, s) in enumerate(starts):
            want.add((id, t, starts[i + 1][0] if i + 1 < len(starts) else -1, json.dumps(dict(canonical_attributes(json.dumps(s))), sort_keys=True)))
    for partitions in (None, 1, 3, 40, 400):  # the hot entity lies in many of them
        got = history(spark, rows, partitions=partitions)
        assert set(got) == want and len(got) == len(want)
    df = spark.createDataFrame(observations(rows), OBS)
    per = attribute_intervals(df, "a", partitions=40).where("id = 'hot'").orderBy("valid_from").collect()
    assert len(per) > 20 and all(a.valid_to <= b.valid_from for a, b in zip(per, per[1:]))


def test_canonical():
    assert canonical_attributes('{"a": 1e2, "b": [true, null, "é"]}') == [("a", "100"), ("b", '[true,null,"\\u00e9"]')]
    assert canonical_attributes('{"a": 100.0}') == [("a", "100")] and canonical_attributes('{"a": -0.0}') == [("a", "0")]
    for bad in (None, "", "{", "[1]", '{"a": NaN}', "3"):
        assert canonical_attributes(bad) is None


WAL = "seq bigint, entry_no bigint, coll_name string, op int, id string, vec_values array<float>, metadata string, ts bigint, at string"


def test_change_feed_equals_sequential(spark):
    random.seed(1)
    rows = []
    for n in range(800):
        id = "hot" if random.random() < 0.4 else f"v{random.randint(0, 25)}"
        op = random.choice([0, 0, 0, 1, 1, 2, 255, None])
        rows.append((n, n, "c", op, random.choice([id] * 30 + [None]), [float(n)] if op == 0 else None, random.choice([None, f'{{"n": {n}}}']) if op == 0 else None, random.randint(0, 300), "x"))
    rows += [(900 + i, *r[1:]) for i, r in enumerate(random.sample(rows, 100))]
    random.shuffle(rows)
    base = [("c", "v1", [-1.0], '{"b": 1}'), ("c", "only", [-2.0], '{"b": 2}'), ("c", None, [0.0], None)]
    state = {(b[0], b[1]): (None, b[2], b[3]) for b in base if b[1]}
    for r in sorted((r for r in rows if r[3] in (0, 1) and r[4]), key=lambda r: (r[7], r[1])):
        key = (r[2], r[4])
        if r[3] == 1:
            state.pop(key, None)
        else:
            old = state.get(key, (None, None, None))
            state[key] = (r[1], r[5], r[6] if r[6] is not None else old[2])
    df = spark.createDataFrame(rows, WAL).repartition(6)
    b = spark.createDataFrame(base, "coll_name string, id string, vec_values array<float>, metadata string")
    got = {(r.coll_name, r.id): (r.entry_no, r.vec_values, r.metadata) for r in current_state(df, b).collect()}
    assert got == state
    assert current_state(df.limit(0)).count() == 0 and apply_patches(compose_patches(df.limit(0)), b).count() == 2
    ties = spark.createDataFrame([(1, 5, "c", 0, "t", [1.0], None, 7, ""), (2, 5, "c", 1, "t", None, None, 7, ""), (3, None, "c", 0, "u", None, None, 7, "")], WAL)
    assert [(r.id, r.entry_no) for r in current_state(ties).collect()] == [("u", None)]


def test_ties_are_one_entry(spark):
    """Entries of one place that differ: the row is one of them, whatever the file ranges."""
    rows = [(i, 5, "c", 0, "t", [float(i)], m, 7, "") for i, m in enumerate([None, '{"a":1}', '{"a":4}', None, '{"a":2}'])]
    for n in (1, 5):
        got = [(r.vec_values, r.metadata) for r in current_state(spark.createDataFrame(rows, WAL).repartition(n)).collect()]
        assert got == [([4.0], '{"a":2}')]


def test_composition_is_associative(spark):
    """Any split of a feed into chunks, composed in any order and nesting, gives one patch."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from sparvex.operators.changefeed import PATCH_TYPE, compose, leaf

    random.seed(2)
    cases = []
    for _ in range(60):
        n = random.randint(3, 12)
        entries = [("k", random.choice([0, 0, 1]), random.randint(0, 4), random.randint(0, 3), None, None) for _ in range(n)]
        entries = [(k, op, ts, no, [float(ts)] if op == 0 else None, random.choice([None, f'{{"m":{no}}}']) if op == 0 else None) for k, op, ts, no, *_ in entries]
        parts = [[], [], []]
        for e in entries:
            random.choice(parts).append(e)

        def patch(rows):
            if not rows:
                return None
            cols = list(zip(*rows))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.string()]
            t = pa.table([pa.chunked_array([pa.array(c, x)]) for c, x in zip(cols, kinds)], names=["id", "op", "ts", "entry_no", "vec_values", "metadata"])
            return leaf(t, ["id"], np.zeros(0, np.int64)).to_pylist()[0]["patch"]

        cases.append((*map(patch, parts), patch(entries)))
    df = spark.createDataFrame(cases, ", ".join(f"{n} {PATCH_TYPE}" for n in ("a", "b", "c", "all")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    out = df.select(compose(compose(a, b), c).alias("x"), compose(a, compose(b, c)).alias("y"), compose(compose(c, a), b).alias("z"), "all").collect()
    assert all(r.x == r["all"] and r.y == r["all"] and r.z == r["all"] for r in out)
