"""Metadata predicates: a small tree, a JSON parser, an evaluator, and compilers to columns.

Predicates are two-valued: an absent field has a fixed answer for each operator (false, but true for $nin, and
for $ne unless its argument is null). `compile_typed` emits native comparisons on typed columns, which reach the
Parquet scan; a negated leaf is pushed down to the leaf and keeps the absent rows. `compile_json` works on a JSON
text column through VARIANT, where JSON null is present and differs from an absent key.

Rules of comparison: numbers compare by value; text and booleans with their own type; all other pairs by their
printed forms, so text "5" equals the argument 5, but a number never equals text. $gt, $gte, $lt and $lte take
everything that is no number for 0. $contains, $startswith and $endswith ignore case and use printed forms, in
which a list is "[a b]". A field with several operators must meet all of them (each written one counts).
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field as _field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGIC = ("$and", "$or", "$not")
COMPARE = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
TEXT = {"$contains": "contains", "$startswith": "startswith", "$endswith": "endswith"}


@dataclass
class Filter:
    operator: str
    field: str = ""
    value: Any = None
    children: list[Filter] = _field(default_factory=list)


def where(name: str, operator: str, value: Any) -> Filter:
    return Filter(operator, name, value)


def equal(name: str, value: Any) -> Filter:
    return Filter("$eq", name, value)


def all_of(*children: Filter) -> Filter:
    return Filter("$and", children=list(children))


def any_of(*children: Filter) -> Filter:
    return Filter("$or", children=list(children))


def negate(child: Filter) -> Filter:
    return Filter("$not", children=[child])


def parse(source: str | dict | None) -> Filter | None:
    """The predicate of a JSON object; None (no filter) for None. Raises ValueError for a wrong shape.

    $and comes before $or before $not; beside one of them other keys are ignored. Several fields are joined by
    and; an empty object matches everything.
    """
    if source is None:
        return None
    obj = json.loads(source) if isinstance(source, str) else source
    if not isinstance(obj, dict):
        raise ValueError("a filter is a JSON object")
    for op in ("$and", "$or"):
        if op in obj:
            if not isinstance(obj[op], list) or not all(isinstance(x, dict) for x in obj[op]):
                raise ValueError(f"{op} needs a list of objects")
            return Filter(op, children=[parse(x) for x in obj[op]])
    if "$not" in obj:
        if not isinstance(obj["$not"], dict):
            raise ValueError("$not needs an object")
        return Filter("$not", children=[parse(obj["$not"])])
    leaves = [leaf for name, want in obj.items() for leaf in _leaves(name, want)]
    return leaves[0] if len(leaves) == 1 else Filter("$and", children=leaves)


def _leaves(name: str, want: Any) -> list[Filter]:
    if isinstance(want, dict) and want and all(k.startswith("$") for k in want):
        return [Filter(op, name, v) for op, v in want.items()]
    return [Filter("$eq", name, want)]


def number(x: Any) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def printed(x: Any) -> str:
    """The plain printed form of a JSON value."""
    if x is None:
        return "<nil>"
    if isinstance(x, bool):
        return "true" if x else "false"
    n = number(x)
    if n is not None:
        return str(int(n)) if math.isfinite(n) and n == int(n) and abs(n) < 1e15 else repr(n)
    if isinstance(x, list):
        return "[" + " ".join(map(printed, x)) + "]"
    if isinstance(x, dict):
        return "map[" + " ".join(f"{k}:{printed(x[k])}" for k in sorted(x)) + "]"
    return str(x)


def same(value: Any, arg: Any) -> bool:
    n = number(value)
    if n is not None:
        m = number(arg)
        return m is not None and n == m
    if type(value) is type(arg) and isinstance(value, (str, bool)):
        return value == arg
    return printed(value) == printed(arg)


def matches(f: Filter | None, metadata: dict[str, Any]) -> bool:
    """The evaluator of one row; the compilers give the same answers."""
    if f is None:
        return True
    op = f.operator
    if op == "$and":
        return all(matches(c, metadata) for c in f.children)
    if op == "$or":
        return any(matches(c, metadata) for c in f.children)
    if op == "$not":
        return not f.children or not matches(f.children[0], metadata)
    if f.field not in metadata:
        return absent(f)
    v, arg = metadata[f.field], f.value
    if op in ("$eq", "$ne"):
        return same(v, arg) == (op == "$eq")
    if op in COMPARE:
        return COMPARE[op](number(v) or 0.0, number(arg) or 0.0)
    if op in ("$in", "$nin"):
        return (isinstance(arg, list) and any(same(v, a) for a in arg)) == (op == "$in")
    if op in TEXT:
        a, b = printed(v).lower(), printed(arg).lower()
        return b in a if op == "$contains" else a.startswith(b) if op == "$startswith" else a.endswith(b)
    if op == "$all":
        return isinstance(v, list) and isinstance(arg, list) and all(any(same(x, a) for x in v) for a in arg)
    return False


def absent(f: Filter) -> bool:
    """The answer of a leaf whose field is absent."""
    return {"$eq": f.value is None, "$ne": f.value is not None, "$nin": True}.get(f.operator, False)


def _compile(f: Filter | None, leaf, negated: bool) -> Column:
    if f is None:
        return F.lit(not negated)
    if f.operator == "$not":
        return _compile(f.children[0], leaf, not negated) if f.children else F.lit(not negated)
    if f.operator in ("$and", "$or"):
        parts = [_compile(c, leaf, negated) for c in f.children]
        both = (f.operator == "$and") != negated
        if not parts:
            return F.lit((f.operator == "$and") != negated)
        out = parts[0]
        for p in parts[1:]:
            out = out & p if both else out | p
        return out
    return leaf(f, negated)


def compile_typed(f: Filter | None, schema: T.StructType, prefix: str = "") -> Column:
    """A column over typed columns; a null is an absent field, and so is a column that doesn't exist."""

    def leaf(f: Filter, negated: bool) -> Column:
        if f.field not in schema.names:
            return F.lit(absent(f) != negated)
        c, kind = F.col(f"{prefix}`{f.field}`"), schema[f.field].dataType
        cond = _typed(f, c, kind)
        known = absent(f) != negated
        if isinstance(cond, bool):
            return F.lit(cond != negated) if cond == absent(f) else (c.isNull() if known else c.isNotNull())
        cond = ~cond if negated else cond
        return c.isNull() | cond if known else cond

    return _compile(f, leaf, False)


def _typed(f: Filter, c: Column, kind: T.DataType) -> Column | bool:
    op, arg = f.operator, f.value
    if op in ("$eq", "$ne"):
        e = _typed_same(c, kind, arg)
        return e if op == "$eq" else (not e if isinstance(e, bool) else ~e)
    if op in COMPARE:
        if isinstance(kind, T.NumericType):
            return COMPARE[op](c, F.lit(number(arg) or 0.0))
        return bool(COMPARE[op](0.0, number(arg) or 0.0))
    if op in ("$in", "$nin"):
        if not isinstance(arg, list) or not arg:
            return op == "$nin"
        if isinstance(kind, T.NumericType):
            own = [number(a) for a in arg if number(a) is not None]
            e = c.isin(own) if own else False
        elif isinstance(kind, T.StringType):
            e = c.isin([a if isinstance(a, str) else printed(a) for a in arg])
        else:
            parts = [_typed_same(c, kind, a) for a in arg]
            parts = [p if isinstance(p, Column) else F.lit(p) for p in parts]
            e = parts[0]
            for p in parts[1:]:
                e = e | p
        return e if op == "$in" else (not e if isinstance(e, bool) else ~e)
    if op in TEXT:
        return getattr(F.lower(_typed_printed(c, kind)), TEXT[op])(F.lit(printed(arg).lower()))
    if op == "$all":
        if not isinstance(kind, T.ArrayType) or not isinstance(arg, list):
            return False
        out: Column = c.isNotNull()
        for a in arg:
            out = out & F.exists(c, _same_as(kind.elementType, a))
        return out
    return False


def _same_as(kind: T.DataType, arg: Any):
    def test(x: Column) -> Column:
        e = _typed_same(x, kind, arg)
        return F.coalesce(e, F.lit(False)) if isinstance(e, Column) else F.lit(e)

    return test


def _typed_same(c: Column, kind: T.DataType, arg: Any) -> Column | bool:
    if isinstance(kind, T.NumericType):
        return c == F.lit(arg) if number(arg) is not None else False
    if isinstance(kind, T.StringType):
        return c == F.lit(arg if isinstance(arg, str) else printed(arg))
    if isinstance(kind, T.BooleanType) and isinstance(arg, bool):
        return c == F.lit(arg)
    return _typed_printed(c, kind) == F.lit(printed(arg))


def _number_printed(c: Column) -> Column:
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def _typed_printed(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return _number_printed(c)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x: F.coalesce(_typed_printed(x, kind.elementType), F.lit("<nil>")))
        return F.concat(F.lit("["), F.array_join(inner, " "), F.lit("]"))
    return c.cast("string")


def compile_json(f: Filter | None, metadata: Column) -> Column:
    """A column over a JSON text; null or unreadable metadata and JSON that is no object have no fields."""
    v = F.try_parse_json(metadata)

    def leaf(f: Filter, negated: bool) -> Column:
        path = "$['" + f.field.replace("\\", "\\\\").replace("'", "\\'") + "']"
        x = F.try_variant_get(v, path, "variant")
        cond = F.coalesce(_variant(f, x), F.lit(False))
        out = F.when(x.isNotNull(), cond).otherwise(absent(f))
        return ~out if negated else out

    return _compile(f, leaf, False)


class _Kinds:
    def __init__(self, x: Column):
        self.x, t = x, F.schema_of_variant(x)
        self.number = t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
        self.text, self.bool, self.null = t == "STRING", t == "BOOLEAN", t == "VOID"
        self.list = t.startswith("ARRAY")

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.x, "$", kind)

    def printed(self, deep: bool = True) -> Column:
        scalar = F.when(self.null, "<nil>").when(self.number, _number_printed(self.get("double"))).when(self.text | self.bool, self.get("string"))
        if deep:
            inner = F.transform(self.get("array<variant>"), lambda e: F.coalesce(_Kinds(e).printed(deep=False), F.to_json(e)))
            scalar = scalar.when(self.list, F.concat(F.lit("["), F.array_join(inner, " "), F.lit("]")))
        return scalar.otherwise(F.to_json(self.x))

    def same(self, arg: Any) -> Column:
        n = number(arg)
        own = F.when(self.number, self.get("double") == F.lit(n) if n is not None else F.lit(False))
        return own.otherwise(self.printed() == F.lit(printed(arg)))


def _same_as_variant(arg: Any):
    return lambda e: F.coalesce(_Kinds(e).same(arg), F.lit(False))


def _variant(f: Filter, x: Column) -> Column:
    op, arg, k = f.operator, f.value, _Kinds(x)
    if op in ("$eq", "$ne"):
        e = F.coalesce(k.same(arg), F.lit(False))
        return e if op == "$eq" else ~e
    if op in COMPARE:
        return COMPARE[op](F.when(k.number, k.get("double")).otherwise(0.0), F.lit(number(arg) or 0.0))
    if op in ("$in", "$nin"):
        e = F.lit(False)
        for a in arg if isinstance(arg, list) else []:
            e = e | F.coalesce(k.same(a), F.lit(False))
        return e if op == "$in" else ~e
    if op in TEXT:
        return getattr(F.lower(k.printed()), TEXT[op])(F.lit(printed(arg).lower()))
    if op == "$all" and isinstance(arg, list):
        out = k.list
        for a in arg:
            out = out & F.exists(k.get("array<variant>"), _same_as_variant(a))
        return out
    return F.lit(False)
