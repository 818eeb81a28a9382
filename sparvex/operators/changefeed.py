"""Applying a stream of inserts, updates and deletes.

Each entry is a patch, a function from a row's state to its state. Patches of one key compose; a composed patch is
kept in normal form, at most three entries of the key that stand for all of them:

    last   the entry with the greatest place (ts, entry_no): its op, entry number and values
    told   the last put with metadata, if no delete stands at or after it
    gone   the place of the last delete

`compose` takes the later of each part, and drops `told` once a delete stands at or after it. The parts carry their own
places, so composition is associative and commutative, and repeats change nothing: any chunk of the feed
reduces on its own. The reduction is a tree:

1. Leaves: each file range is cut into range chunks of time (`CHUNKS` quantiles of ts over the whole feed) and its
   entries are reduced to one patch for each key and chunk before anything is shuffled, as arrays.
2. Patches of one key and one chunk are composed, whatever file ranges they come from.
3. The chunks' patches of a key are composed, and applied to a base.

So a key that holds a third of all rows gives one patch for each file range and chunk, and is reduced by many tasks.

Rules
- An entry with an `op` other than 0 (put) and 1 (delete), or a null op, key, ts, changes nothing.
  A null `entry_no` is the lowest of its time.
- The entry with the greatest (ts, entry_no) decides. Entries that are equal in both are repeats; if they differ, a
  delete wins, then an entry with metadata, then the greatest values, then the greatest metadata, as one entry: a
  row never mixes two of them. Values are compared from the left, nulls are lowest, NaN is greatest.
- A put replaces the values. Metadata that is null in a put leaves the metadata given by an earlier put
  since the last delete.
- `base` rows hold before every entry. An empty feed gives the base; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = 0, 1
CHUNKS = 64
#: Rows of a leaf, and the entry number that stands for null.
LEAF_ROWS, LOWEST = 65_536, -(2**63)
_PLACE = "ts:bigint,entry_no:bigint"
#: The parts of a patch. Structs compare from the left, which is the order of the rules.
PATCH = {
    "last": f"struct<{_PLACE},op:int,has:boolean,vec_values:array<float>,metadata:string>",
    "told": f"struct<{_PLACE},vec_values:array<float>,metadata:string>",
    "gone": f"struct<{_PLACE}>",
}
PATCH_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in PATCH.items()) + ">"


def later(a: Column, b: Column) -> Column:
    """The greater of two structs; null is the lowest."""
    return F.when(b.isNull() | (a >= b), a).otherwise(b)


def compose(f: Column, g: Column) -> Column:
    """The patch of what `f` and `g` hold together. Nulls are the patch that changes nothing."""
    gone, told = later(f["gone"], g["gone"]), later(f["told"], g["told"])
    hidden = F.struct(told["ts"].alias("ts"), told["entry_no"].alias("entry_no")) <= gone
    both = F.struct(
        later(f["last"], g["last"]).alias("last"), F.when(~F.coalesce(hidden, F.lit(False)), told).alias("told"), gone.alias("gone")
    )
    return F.when(f.isNull(), g).when(g.isNull(), f).otherwise(both)


def _reduced(patches: DataFrame, by: list[str]) -> DataFrame:
    """The patches composed by the columns `by`: at most one for each file range and chunk, or for each chunk."""
    all_ = patches.groupBy(*by).agg(F.collect_list("patch").alias("_p"))
    return all_.select(*by, F.aggregate("_p", F.lit(None).cast(PATCH_TYPE), compose).alias("patch"))


def _rank(values: list | None, metadata: str | None) -> tuple:
    """The order of the rules for entries of one place, op and presence of metadata."""
    if values is not None:
        values = tuple((x is not None, x != x if x is not None else False, x if x is not None and x == x else 0.0) for x in values)
    return values is not None, values or (), metadata is not None, metadata or ""


def leaf(t: pa.Table, keys: list[str], bounds: np.ndarray) -> pa.Table:
    """Entries (keys, op, ts, entry_no, vec_values, metadata) of valid ops as patches: keys, chunk, patch."""
    n = len(t)
    group = np.searchsorted(bounds, ts := t["ts"].to_numpy(), "right").astype(np.int64)
    chunk = group
    for k in keys:
        codes = t[k].combine_chunks().dictionary_encode()
        group = np.unique(group * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
    no = t["entry_no"].fill_null(LOWEST).to_numpy()
    op = t["op"].to_numpy().astype(np.int32)
    has = t["metadata"].is_valid().to_numpy(zero_copy_only=False)
    order = np.lexsort((has, op, no, ts, group))
    # repeats: entries of one place, op and presence of metadata. The greatest one goes last.
    same = np.ones(n, bool)
    for a in (group, ts, no, op, has):
        same[1:] &= a[order[1:]] == a[order[:-1]]
    same[:1] = False
    bare = t["metadata"].null_count == n and t["vec_values"].null_count == n
    starts = np.zeros(0, int) if bare else np.flatnonzero(same & ~np.append(False, same[:-1])) - 1
    for i in starts.tolist():
        z = i + 1
        while z < n and same[z]:
            z += 1
        if op[order[i]] == PUT:
            rows = order[i:z]
            values, texts = t["vec_values"].take(pa.array(rows)).to_pylist(), t["metadata"].take(pa.array(rows)).to_pylist()
            order[i:z] = rows[sorted(range(z - i), key=lambda r: _rank(values[r], texts[r]))]
    first = np.flatnonzero(np.append(True, group[order[1:]] != group[order[:-1]])) if n else np.zeros(0, int)
    at = np.arange(n)
    most = lambda where: np.maximum.reduceat(np.where(where, at, -1), first) if n else first
    last = np.append(first[1:], n) - 1
    gone = most(op[order] == DELETE)
    told = most((op[order] == PUT) & has[order])
    told = np.where(told > gone, told, -1)
    # a delete at the place of a put stands after it in the order, so the comparison of places is that of numbers

    def part(places: np.ndarray, fields: list[str]) -> pa.StructArray:
        none = places < 0
        rows = pa.array(order[np.maximum(places, 0)], mask=none)
        cols = {"ts": t["ts"], "entry_no": pa.array(no), "op": pa.array(op), "has": pa.array(has), "vec_values": t["vec_values"], "metadata": t["metadata"]}
        arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (cols[f].take(rows) for f in fields)]
        return pa.StructArray.from_arrays(arrays, names=fields, mask=pa.array(none))

    place = ["ts", "entry_no"]
    parts = [part(last, [*place, "op", "has", "vec_values", "metadata"]), part(told, [*place, "vec_values", "metadata"]), part(gone, place)]
    heads = pa.array(order[first])
    out = {k: t[k].take(heads) for k in keys} | {"chunk": pa.array(chunk[order[first]].astype(np.int32))}
    return pa.table(out | {"patch": pa.StructArray.from_arrays(parts, names=list(PATCH))})


def leaf_patches(entries: DataFrame, keys: list[str], bounds: list[int]) -> DataFrame:
    """keys, chunk, patch: the patches of each file range, by key and range chunk of time."""
    schema = T.StructType([entries.schema[k] for k in keys])
    schema = schema.add("chunk", T.IntegerType()).add("patch", T.DataType.fromDDL(PATCH_TYPE))
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= LEAF_ROWS:
                yield from leaf(pa.Table.from_batches(held).combine_chunks(), keys, edges).to_batches()
                held = []
        if held:
            yield from leaf(pa.Table.from_batches(held).combine_chunks(), keys, edges).to_batches()

    return entries.mapInArrow(run, schema)


def compose_patches(
    entries: DataFrame, keys: list[str] = ["coll_name", "id"], chunks: int = CHUNKS, contents: bool = True  # noqa: B006
) -> DataFrame:
    """One patch per key: keys, op, entry_no, ts, vec_values, metadata, resets.

    `resets` is true if a delete lies in the patch at or after the metadata that it carries, so that
    metadata of an older state must not show through. Without `contents` the patches carry no values and metadata.
    """
    rows = entries.where(F.col("op").isin(PUT, DELETE) & F.col("ts").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    values = F.col("vec_values").cast("array<float>") if contents else F.lit(None).cast("array<float>")
    text = F.col("metadata") if contents else F.lit(None).cast("string")
    rows = rows.select(*keys, F.col("op").cast("int").alias("op"), F.col("ts").cast("bigint").alias("ts"), F.col("entry_no").cast("bigint").alias("entry_no"), values.alias("vec_values"), text.alias("metadata"))
    cuts = rows.agg(F.percentile_approx("ts", [i / chunks for i in range(1, chunks)], 10_000)).first()[0] if chunks > 1 else None
    patch = _reduced(_reduced(leaf_patches(rows, keys, sorted(set(cuts or []))), [*keys, "chunk"]), keys)
    last, put = F.col("patch.last"), F.col("patch.last.op") == PUT
    return patch.select(
        *keys,
        last["op"].alias("op"),
        F.nullif(last["entry_no"], F.lit(LOWEST).cast("bigint")).alias("entry_no"),
        last["ts"].alias("ts"),
        F.when(put, last["vec_values"]).alias("vec_values"),
        F.when(put, F.col("patch.told.metadata")).alias("metadata"),
        F.col("patch.gone").isNotNull().alias("resets"),
    )


def apply_patches(patches: DataFrame, base: DataFrame | None = None, keys: list[str] = ["coll_name", "id"]) -> DataFrame:  # noqa: B006
    """The live rows: keys, entry_no, ts, vec_values, metadata. Rows of the base without a patch have null entry_no."""
    cols = [*keys, "entry_no", "ts", "vec_values", "metadata"]
    if base is None:
        return patches.where(F.col("op") == PUT).select(*cols)
    b = base.select(*keys, F.col("vec_values").alias("_values"), F.col("metadata").alias("_metadata"))
    for k in keys:
        b = b.where(F.col(k).isNotNull())
    b = b.groupBy(*keys).agg(F.max(F.struct("_values", "_metadata")).alias("_b")).select(*keys, "_b.*")
    both = b.join(patches, keys, "full")
    live = both.where(F.col("op").isNull() | (F.col("op") == PUT))
    return live.select(
        *keys,
        "entry_no",
        "ts",
        F.when(F.col("op").isNull(), F.col("_values")).otherwise(F.col("vec_values")).alias("vec_values"),
        F.when(F.coalesce("resets", F.lit(False)), F.col("metadata")).otherwise(F.coalesce("metadata", "_metadata")).alias("metadata"),
    )


def current_state(entries: DataFrame, base: DataFrame | None = None, keys: list[str] = ["coll_name", "id"], contents: bool = True) -> DataFrame:  # noqa: B006
    """The state of the table after the whole feed."""
    return apply_patches(compose_patches(entries, keys, contents=contents), base, keys)
