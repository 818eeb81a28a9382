"""History of changing entity attributes.

Observations of an entity (snapshots and updates, repeated, late, in several time units) become an event-sourced
change log per attribute, then intervals per attribute, then whole-state periods: the intervals are split at
the union of all boundary dates of the entity and coalesced where nothing differs.

Plan: one shuffle. Rows are range partitioned and sorted by (entity, time), so an entity that holds a third of all rows
is cut into many partitions at the bounds that Spark samples, and other entities lie in one. A partition is swept
once, in order, as a stream: memory holds one state. Only the first state of a partition's first entity and the
last one of its last entity may belong together with another partition's; these rows, two a partition at most, are
stitched by a window over them alone.

Rules
- A row counts if its entity keys and time are not null and its metadata is null or one JSON object.
  Unreadable text, an empty string and JSON that is no object do not count. The JSON text `null` is null.
- Times are brought to nanoseconds by magnitude (seconds, milliseconds, microseconds, nanoseconds).
- Of rows with equal time only the one with the highest version counts (a null version is the lowest; of
  equal versions one with metadata, then the greatest canonical text).
- Null metadata leaves the state as it was; before any state there is none.
- Values are compared as JSON values: numbers by value, object keys in any order. A repeated key keeps its
  last value. Attributes are the top-level keys.
- An empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import Context, Decimal
from json.encoder import encode_basestring_ascii as quoted

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut

#: Distinct texts whose canonical form a task keeps.
CACHE = 50_000
_LOW = -(2**63)


def to_nanoseconds(ts: Column) -> Column:
    """Unix time in s, ms, us or ns (told by magnitude) as nanoseconds."""
    size = F.abs(ts)
    return (
        F.when(size < 10**11, ts * 10**9).when(size < 10**14, ts * 10**6).when(size < 10**17, ts * 10**3).otherwise(ts)
    ).cast("bigint")


def _no_constant(name: str):
    raise ValueError(name)


_EXACT = Context(prec=1000)


class _Number(str):
    """A number's canonical text: one text for one value (exact up to 1000 digits)."""


def _number(s: str) -> _Number:
    if len(s) > 38 or "e" in s or "E" in s:
        x = _EXACT.normalize(Decimal(s))
        return _Number(format(x, "f") if x and abs(x.adjusted()) < 40 else str(x) if x else "0")
    if "." in s:
        s = s.rstrip("0").rstrip(".")
    return _Number("0" if s == "-0" else s)


_decode = json.JSONDecoder(parse_float=_number, parse_int=_number, parse_constant=_no_constant).decode


def _canonical(x) -> str:
    if isinstance(x, _Number):
        return str(x)
    if isinstance(x, str):
        return quoted(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{quoted(k)}:{_canonical(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_canonical, x)) + "]"
    return json.dumps(x)


def canonical_attributes(text: str | None) -> list[tuple[str, str]] | None:
    """(attribute, canonical JSON value) of a JSON object, sorted; None if the text is no JSON object."""
    try:
        obj = _decode(text)
        return sorted((quoted(k)[1:-1], _canonical(v)) for k, v in obj.items()) if isinstance(obj, dict) else None
    except (ValueError, RecursionError, ArithmeticError, TypeError):
        return None


def changes_between(before: dict[str, str] | None, after: dict[str, str]) -> list[tuple[str, str | None]]:
    """The events of the log: (attribute, new value), None for an attribute that goes."""
    if before is None:
        return list(after.items())
    if before == after:
        return []
    made = [(k, v) for k, v in after.items() if before.get(k) != v]
    return made + [(k, None) for k in before if k not in after]


class Sweep:
    """The periods of one partition, rows coming in order of (entity, time).

    `open_` has the open interval of every attribute, (value, its beginning): the last entry of the attribute's own log.
    Each time with events is a boundary. The period before it is the piece of all open intervals between two boundaries; an
    observation without events is no boundary, so neighbours are coalesced.
    """

    def __init__(self, attributes: list[str] | None):
        self.attributes = set(attributes) if attributes is not None else None
        self.out: list[tuple] = []  # entity, valid_from, valid_to or None if open, edge, attributes
        self.key, self.first_key = None, True
        self.open_: dict[str, tuple[str, int]] = {}
        self.since: int | None = None  # the last boundary of the entity
        self.head = True  # whether the open period is the first one of the partition's first entity

    def entity(self, key: tuple | None) -> None:
        """Another entity begins, or (None) the partition ends."""
        if self.since is not None:
            edge = self.head or key is None
            self._emit(None if edge else -1, edge)
        if self.key is not None:
            self.first_key = False
        self.key, self.since, self.open_, self.head = key, None, {}, self.first_key

    def _emit(self, to: int | None, edge: bool) -> None:
        self.out.append((self.key, self.since, to, edge, [(k, v) for k, (v, _) in sorted(self.open_.items())]))

    def state(self, at: int, attributes: list[tuple[str, str]]) -> None:
        after = {k: v for k, v in attributes if self.attributes is None or k in self.attributes}
        known = self.since is not None
        events = changes_between({k: v for k, (v, _) in self.open_.items()} if known else None, after)
        if known and not events:
            return
        if known:
            self._emit(at, self.head)
            self.head = False
        self.since = at
        for k, v in events:
            if v is None:
                del self.open_[k]
            else:
                self.open_[k] = (v, at)


def _best(rows: list[tuple], canonical) -> list[tuple[str, str]] | None:
    """The attributes of the row that counts among rows (version, text) of one time; None if it has none, or no row counts."""
    best = None
    for version, text in rows:
        attributes = canonical(text) if text is not None else None
        if text is None or attributes is not None:
            rank = (version, text is not None)
            if best is None or rank > best[0]:
                best = (rank, attributes)
            elif rank == best[0] and attributes and attributes != best[1]:
                texts = [json.dumps([{"key": k, "value": v} for k, v in a], separators=(",", ":")) for a in (attributes, best[1])]
                best = (rank, max(zip(texts, (attributes, best[1])))[1])
    return best[1] if best else None


def _swept(batches: Iterator[pa.RecordBatch], n_keys: int, attributes: list[str] | None, names: list[str], kinds: list[pa.DataType], contents: bool) -> Iterator[pa.RecordBatch]:
    sweep, known, place = Sweep(attributes), {}, None
    same: list[tuple] = []  # the distinct rows of one entity and time

    def canonical(text: str) -> list[tuple[str, str]] | None:
        if text not in known:
            if len(known) >= CACHE:
                known.clear()
            known[text] = canonical_attributes(text)
        return known[text]

    def commit() -> None:
        got = _best(same, canonical)
        if got is not None:
            sweep.state(place[1], got)

    def rows() -> pa.RecordBatch:
        out, sweep.out = sweep.out, []
        keys = [pa.array([r[0][i] for r in out], kinds[i]) for i in range(n_keys)]
        marks = [hashlib.md5(json.dumps(r[4]).encode()).digest() if r[3] else None for r in out]
        times = [pa.array([r[i] for r in out], pa.int64()) for i in (1, 2)]
        attrs = pa.array([r[4] if contents else None for r in out], pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([*keys, *times, pa.array([r[3] for r in out], pa.bool_()), pa.array(marks, pa.binary()), attrs], names=names)

    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for key, at, version, text in zip(zip(*cols[:n_keys]), *cols[n_keys:]):
            if place is None or at != place[1] or key != place[0]:
                if place is not None:
                    commit()
                if place is None or key != place[0]:
                    sweep.entity(key)
                place, same = (key, at), [(version, text)]
            elif (version, text) not in same:
                same.append((version, text))
        if len(sweep.out) >= 4096:
            yield rows()
    if place is not None:
        commit()
        sweep.entity(None)
    yield rows()


def _stitched(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The periods at the partitions' edges, joined: of an entity, an open period goes on in the next one if their
    states are equal, and ends there if not. At most two rows a partition."""
    w = Window.partitionBy(*keys).orderBy("valid_from")
    goes_on = F.lag("valid_to").over(w).isNull() & (F.lag("mark").over(w) == F.col("mark"))
    runs = edges.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    last = F.max_by(F.struct("valid_to", "attrs"), "valid_from").alias("_l")
    runs = runs.groupBy(*keys, "_run").agg(F.min("valid_from").alias("valid_from"), last)
    to = F.coalesce("_l.valid_to", F.lead("valid_from").over(w), F.lit(-1))
    return runs.select(*keys, "valid_from", to.alias("valid_to"), "_l.attrs")


def attribute_history(
    df: DataFrame,
    keys: list[str] = ["coll_name", "id"],  # noqa: B006
    version: str = "vec_version",
    ts: str = "vec_ts",
    metadata: str = "metadata",
    attributes: list[str] | None = None,
    contents: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """The full history of each entity: keys, valid_from, valid_to (-1: still valid), attrs.

    `attributes` restricts it to some attributes. Without `contents` attrs is null. `partitions`: the number of range
    partitions, if not the session's.
    """
    text = F.when(F.trim(F.col(metadata)) != "null", F.col(metadata))
    number = F.coalesce(F.col(version).cast("bigint"), F.lit(_LOW).cast("bigint"))
    rows = df.select(*keys, to_nanoseconds(F.col(ts)).alias("ts_ns"), number.alias("_v"), text.alias("_text")).where(F.col("ts_ns").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    order = [*keys, "ts_ns"]
    rows = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    schema = T.StructType([rows.schema[k] for k in keys]).add("valid_from", T.LongType()).add("valid_to", T.LongType())
    schema = schema.add("edge", T.BooleanType()).add("mark", T.BinaryType()).add("attrs", T.MapType(T.StringType(), T.StringType()))
    kinds, names, n = [_arrow(rows.schema[k].dataType) for k in keys], schema.names, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _swept(batches, n, attributes, names, kinds, contents)

    swept = cut(rows.mapInArrow(run, schema))  # read twice
    cols = [*keys, "valid_from", "valid_to", "attrs"]
    return swept.where(~F.col("edge")).select(*cols).unionByName(_stitched(swept.where("edge"), keys))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def attribute_intervals(df: DataFrame, attribute: str, keys: list[str] = ["coll_name", "id"], **options) -> DataFrame:  # noqa: B006
    """keys, value, valid_from, valid_to: the intervals of one attribute. Where it is absent there is none."""
    h = attribute_history(df, keys, attributes=[attribute], **options)
    value = F.try_element_at("attrs", F.lit(attribute))
    return h.where(value.isNotNull()).select(*keys, value.alias("value"), "valid_from", "valid_to")
