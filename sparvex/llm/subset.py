"""A varied subset of given size.

Two-round lazy greedy maximisation of a submodular facility-location objective. A subset is worth

    sum over vectors v of  max over chosen s of  min(cosine(v, s), ENOUGH) / ENOUGH        (negative: 0)
  + for each value of the `vary_by` field that is chosen, VALUE_SHARE x n / number of values

The cut at ENOUGH makes a group of similar vectors covered by one member: a second one of a large group earns
nothing, so large groups are not over-represented. Copies count once; those with another value of the field than the
first of them may be chosen for it. Round 1: parts of about `PART_ROWS` vectors (by hash), or four times the size if
that is more, each nominate `size` candidates, every candidate with the number of vectors that are nearest to it.
Round 2: a greedy pass over the weighted candidates selects. While the candidates are more than one part, round 1 is
repeated on them in other parts; each time they become fewer than half, and no task holds more rows than a part.
Requests that differ in size alone are one run: a greedy choice of more begins with the choice of fewer.

Rules: a request with a null collection, or a size that is null or below 1, gives nothing. If the collection has
fewer directions than asked for, copies fill up by id; if it has fewer vectors, all come out. Unreadable metadata
and absent or null fields have no value; values are compared without case and blanks, numbers by value. Ties go
to the smaller id. A repeated request row is one request.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .vectors import directions, matrix, unit

PART_ROWS = 4096
ENOUGH = 0.85
VALUE_SHARE = 0.5
_KEYS = ["run", "coll_name", "size"]
_ROWS = "run string, coll_name string, size int, id string, vec_values array<float>, value string, weight double, rank int"
_BLOCK = 1024


def lazy_greedy(x: np.ndarray, weight: np.ndarray, value: np.ndarray, size: int) -> tuple[list[int], np.ndarray]:
    """Chosen rows of unit vectors `x` in order, and for every row the chosen one it is nearest to (its place).

    value: a number for each row's field value, -1 for none.
    """
    x = x.astype(np.float32)

    whole = len(x) <= 1.25 * PART_ROWS  # an ordinary part: all similarities fit at once
    table = None

    def cover(rows) -> np.ndarray:
        if table is not None:
            return table[rows]
        c = x[rows] @ x.T
        return np.minimum(np.maximum(c, 0, out=c), ENOUGH, out=c) / np.float32(ENOUGH)

    table = cover(slice(None)) if whole else None
    bonus = VALUE_SHARE * weight.sum() / max(1, len(np.unique(value[value >= 0])))
    best, seen, chosen = np.zeros(len(x), np.float32), set(), []
    w = weight.astype(np.float32)

    def gain(i: int) -> float:
        return float(np.maximum(cover(i) - best, 0) @ w) + (bonus if value[i] >= 0 and value[i] not in seen else 0.0)

    first = np.concatenate([cover(slice(i, i + _BLOCK)) @ w for i in range(0, len(x), _BLOCK)]) if len(x) else w
    first = first + np.where(value >= 0, bonus, 0)
    heap = [(-g, i, 0) for i, g in enumerate(first.tolist())]
    heapq.heapify(heap)
    while heap and len(chosen) < size:
        g, i, at = heapq.heappop(heap)
        if at < len(chosen):  # an old gain bounds the new one from above
            heapq.heappush(heap, (-gain(i), i, len(chosen)))
            continue
        chosen.append(i)
        seen.add(value[i])
        np.maximum(best, cover(i), out=best)
    near = [np.argmax(x[i : i + _BLOCK] @ x[chosen].T, 1) for i in range(0, len(x), _BLOCK)] if chosen else []
    return chosen, np.concatenate(near) if near else np.zeros(len(x), int)


def _nominate(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    t = t.sort_by("id")
    values = {v: i for i, v in enumerate(sorted({v for v in t["value"].to_pylist() if v is not None}))}
    value = np.array([values.get(v, -1) for v in t["value"].to_pylist()])
    weight = t["weight"].to_numpy()
    chosen, near = lazy_greedy(unit(matrix(t["vec_values"])), weight, value, t["size"][0].as_py())
    out = t.take(pa.array(chosen, pa.int64())).drop_columns(["part", "weight", "rank"])
    out = out.append_column("weight", pa.array(np.bincount(near, weight, len(chosen))))
    return out.append_column("rank", pa.array(np.arange(1, len(chosen) + 1, dtype=np.int32)))


def _selected(rows: DataFrame) -> DataFrame:
    """The nominations and the selection of all runs."""
    for turn in range(64):
        parts = F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(PART_ROWS), 4 * F.max("size"))).cast("int")
        sizes = cut(rows.groupBy("run").agg(parts.alias("parts")))  # one row per run
        most = sizes.agg(F.max("parts")).first()[0] or 0
        part = F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts")).cast("int")
        rows = rows.join(sizes, "run").withColumn("part", part).drop("parts").groupBy(*_KEYS, "part").applyInArrow(_nominate, _ROWS)
        if most <= 1:
            return rows
        rows = cut(rows)
    raise RuntimeError("the candidates did not become fewer")


def varied_subsets(usable: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, coll_name, rank (from 1, in order of choice), id."""
    asked = requests.select("request_id", "coll_name", F.col("subset_size").cast("int").alias("subset_size"), "vary_by").distinct()
    asked = asked.where(F.col("coll_name").isNotNull() & F.col("request_id").isNotNull() & (F.col("subset_size") > 0))
    asked = asked.withColumn("run", F.to_json(F.struct("coll_name", "vary_by")))
    runs = asked.groupBy("run", "coll_name", "vary_by").agg(F.max("subset_size").alias("size"))
    keyed = cut(directions(usable.select("coll_name", "id", "vec_values", "metadata"), 1))
    field = F.lower(F.trim(F.try_element_at(F.from_json("metadata", "map<string,string>"), F.col("vary_by"))))
    field = F.coalesce(field.try_cast("double").cast("string"), field)
    all_ = keyed.join(runs, "coll_name").withColumn("value", field)
    heads = all_.where(F.col("ids").isNotNull())
    rows = heads.select(*_KEYS, "id", "vec_values", "value", F.lit(1.0).alias("weight"), F.lit(0).alias("rank"))
    # copies with values that the first one has not: candidates without a weight
    other = all_.where(F.col("ids").isNull() & F.col("value").isNotNull()).groupBy(*_KEYS, "dir_key", "value").agg(F.min("id").alias("id"))
    known = heads.where(F.col("vary_by").isNotNull()).select("run", "dir_key", "vec_values", F.col("value").alias("_known"))
    other = other.join(known, ["run", "dir_key"]).where(~F.col("value").eqNullSafe(F.col("_known")))
    rows = rows.unionByName(other.select(*_KEYS, "id", "vec_values", "value", F.lit(0.0).alias("weight"), F.lit(0).alias("rank")))
    ranked = cut(_selected(rows).select("run", "rank", "id"))
    chosen = asked.join(ranked, "run").where(F.col("rank") <= F.col("subset_size"))
    short = chosen.groupBy("request_id", "coll_name", "subset_size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < F.col("subset_size"))
    short = cut(short)  # one row per request
    most = short.agg(F.max(F.col("subset_size") - F.col("n"))).first()[0] or 0
    chosen = chosen.select("request_id", "coll_name", "rank", "id")
    if not most:
        return chosen
    rest = short.join(keyed.where(F.col("ids").isNull()).select("coll_name", "id"), "coll_name").join(chosen.select("request_id", "id"), ["request_id", "id"], "left_anti")
    w = Window.partitionBy("request_id", "coll_name").orderBy("id")
    rest = rest.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)  # a number, so that Spark limits the ranks before the shuffle
    rest = rest.where(F.col("_rn") <= F.col("subset_size") - F.col("n"))
    return chosen.unionByName(rest.select("request_id", "coll_name", (F.col("n") + F.col("_rn")).cast("int").alias("rank"), "id"))
