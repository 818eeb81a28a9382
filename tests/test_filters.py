import itertools
import json

import pytest
from pyspark.sql import functions as F

from sparvex.functions import filters as P

TYPED = "i long, d double, s string, b boolean, a array<string>"
ROWS = [
    (5, 1.5, "Go Lang", True, ["go", "db"]), (0, 0.0, "", False, []), (-3, 2023.0, "5", None, ["5", None]), (None, None, None, None, None), (12, float("nan"), "true", True, ["a"]),
]
ARGS = [5, 0, 1.5, "5", "go", "true", True, None, [5, "5", "go"], ["go"], [], "a]"]
OPS = ["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$contains", "$startswith", "$endswith", "$all", "$odd"]
LEAVES = [P.where(f, o, a) for f, o, a in itertools.product(["i", "d", "s", "b", "a", "zz"], OPS, ARGS)]


def test_typed_equals_the_evaluator(spark):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(ROWS)], "n int, " + TYPED)
    names = ["i", "d", "s", "b", "a"]
    rows = [{k: v for k, v in zip(names, r) if v is not None} for r in ROWS]
    trees = [t for t in LEAVES if not (t.field == "d" and t.operator in (*P.COMPARE, *P.TEXT))]  # NaN compares by Spark's order
    for part in range(0, len(trees), 60):
        some = trees[part : part + 60]
        cols = [F.coalesce(P.compile_typed(x, df.schema), F.lit(False)).alias(f"c{i}{s}") for i, t in enumerate(some) for s, x in (("p", t), ("n", P.negate(t)))]
        for row, got in zip(rows, df.select("n", *cols).orderBy("n").collect()):
            for i, t in enumerate(some):
                want = P.matches(t, row)
                if isinstance(row.get(t.field), float) and row[t.field] != row[t.field]:
                    continue
                assert (got[f"c{i}p"], got[f"c{i}n"]) == (want, not want), (t, row)


def test_json_equals_the_evaluator(spark):
    docs = [
        {"i": 5, "d": 1.5, "s": "Go Lang", "b": True, "a": ["go", "db"]}, {"i": 0, "s": "", "b": False, "a": []}, {"i": "5", "d": None, "s": 5, "b": "true", "a": ["5", 5]},
        {}, {"i": 2023.0, "d": -0.25, "s": None, "a": "go"}, {"i": [1], "d": True, "s": True},
    ]
    df = spark.createDataFrame([(n, json.dumps(x)) for n, x in enumerate(docs)] + [(6, None), (7, '{"i": 5'), (8, "[]")], "n int, m string")
    for part in range(0, len(LEAVES), 60):
        some = LEAVES[part : part + 60]
        cols = [P.compile_json(x, F.col("m")).alias(f"c{i}{s}") for i, t in enumerate(some) for s, x in (("p", t), ("n", P.negate(t)))]
        for row, got in zip([*docs, {}, {}, {}], df.select("n", *cols).orderBy("n").collect()):
            for i, t in enumerate(some):
                want = P.matches(t, row)
                assert (got[f"c{i}p"], got[f"c{i}n"]) == (want, not want), (t, row)


def test_parser():
    assert P.parse(None) is None and P.matches(P.parse("{}"), {"x": 1})
    assert P.matches(P.parse({"$and": [{"a": 1}], "$or": [], "b": 2}), {"a": 1})  # siblings of $and are ignored
    assert not P.matches(P.parse({"$or": []}), {}) and P.matches(P.parse({"$and": []}), {})
    assert P.matches(P.parse({"a": {"$gte": 1, "$lt": 9}}), {"a": 5}) and not P.matches(P.parse({"a": {"$gte": 1, "$lt": 9}}), {"a": 9})
    assert P.matches(P.parse({"$not": {"a": 1}}), {}) and P.matches(P.parse({"x.y": 1}), {"x.y": 1})
    assert P.matches(P.parse({"f": {}}), {"f": {}}) and not P.matches(P.parse({"f": {}}), {"f": 1})
    for bad in ({"$and": {}}, {"$or": [1]}, {"$not": []}, "[1]", "{"):
        with pytest.raises(ValueError):
            P.parse(bad)


def test_pushdown(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "label int, s string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(P.compile_typed(P.parse({"label": 3, "$x": 1, "s": {"$ne": "y"}}), df.schema))._jdf.queryExecution().toString()
    df2 = df.where(P.compile_typed(P.parse({"label": 3}), df.schema))._jdf.queryExecution().toString()
    assert "EqualTo(label,3)" in df2 and plan
