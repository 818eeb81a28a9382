"""The current, usable vectors of an export, and groups of copies among them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def current_vectors(vectors: DataFrame, columns: tuple[str, ...] = ("vec_values", "metadata")) -> DataFrame:
    """coll_name, id and `columns`: the row of the highest `vec_version` of each vector.

    Of equal versions the latest `vec_ts`, then `exported_at`, then the greatest values, then metadata by its
    hash count; nulls are lowest. Rows with a null collection or id name no vector and are left out.
    """
    last = F.struct("vec_version", "vec_ts", "exported_at", "vec_values", F.xxhash64("metadata").alias("_h"), *[c for c in columns if c != "vec_values"])
    rows = vectors.where(F.col("coll_name").isNotNull() & F.col("id").isNotNull())
    rows = rows.groupBy("coll_name", "id").agg(F.max(last).alias("_r"))
    return rows.select("coll_name", "id", *(F.col(f"_r.{c}") for c in columns))


def usable_vectors(vectors: DataFrame, config: DataFrame, columns: tuple[str, ...] = ("vec_values", "metadata")) -> DataFrame:
    """Current vectors whose values have the collection's dimension, no null, NaN or infinity, and are not all zero.

    A collection without a configuration has no usable vectors.
    """
    dims = config.where(F.col("dim") > 0).groupBy("coll_name").agg(F.max("dim").alias("_dim"))
    v = current_vectors(vectors, columns).join(dims, "coll_name")
    x = F.col("vec_values")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return v.where((F.size(x) == F.col("_dim")) & fine & F.exists(x, lambda e: e != 0)).drop("_dim")


def matrix(values: pa.Array, dtype=np.float64) -> np.ndarray:
    """The rows of a list array of equal lengths as a matrix."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(values), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@F.arrow_udf(T.BinaryType())
def _direction_key(values: pa.Array) -> pa.Array:
    out: list = [None] * len(values)
    lengths = np.asarray(values.value_lengths())
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        key = np.round(unit(matrix(values.take(pa.array(rows)))) * 1e5).astype(np.int32) + 0
        for r, k in zip(rows.tolist(), key):
            out[r] = hashlib.md5(k.tobytes()).digest()
    return pa.array(out, pa.binary())


def directions(usable: DataFrame, keep: int) -> DataFrame:
    """coll_name, id, dir_key, ids, vec_values (float) and the other columns of `usable`.

    `dir_key` is equal for copies, also scaled ones (the unit vectors agree to five decimals). The smallest id of
    a direction stands for it: only its row has the values and `ids`, the `keep` smallest ids of the direction.
    The rank limit is applied before the shuffle, so a group of copies of any size sends few rows, and only keys
    are shuffled: the values stay where finding the current rows has put them.
    """
    # The Python function stays off the values' path: behind it Spark would not know their partitioning any more.
    keyed = usable.select("coll_name", "id", _direction_key("vec_values").alias("dir_key"))
    w = Window.partitionBy("coll_name", "dir_key").orderBy("id")
    few = keyed.select("coll_name", "dir_key", "id", F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= keep)
    heads = few.groupBy("coll_name", "dir_key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    heads = heads.select("coll_name", F.col("ids")[0].alias("id"), "ids")
    whole = usable.join(keyed.join(heads, ["coll_name", "id"], "left"), ["coll_name", "id"])
    return whole.withColumn("vec_values", F.when(F.col("ids").isNotNull(), F.col("vec_values").cast("array<float>")))
