"""Vector metrics as column expressions: element casts to DOUBLE and left folds, all inside the JVM.

Vectors of different or zero length, or null ones, give the metric's mismatch value: similarity 0 (cosine distance
1), dot 0, Euclidean and Manhattan the greatest float, Hamming the first vector's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what the distances give for vectors that don't match (the greatest 32-bit float).
MAX_FLOAT = 3.4028234663852886e38
#: The metrics' numbers in a collection's configuration, and their names and aliases.
METRICS = {"cosine": 0, "euclidean": 1, "dot": 2, "manhattan": 3, "hamming": 4}
ALIASES = {"l2": "euclidean", "dot_product": "dot", "ip": "dot", "l1": "manhattan"}


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), f), F.lit(0.0), lambda s, x: s + x)


def _guard(a: Column, b: Column, value: Column, mismatch: Column | float) -> Column:
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(F.coalesce(fits, F.lit(False)), value).otherwise(mismatch if isinstance(mismatch, Column) else F.lit(mismatch))


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = magnitude(v)
    return F.when(n > 0, F.transform(_d(v), lambda x: x / n)).otherwise(_d(v))


def dot(a: Column, b: Column) -> Column:
    return _guard(a, b, _fold(a, b, lambda x, y: x * y), 0.0)


def cosine_similarity(a: Column, b: Column) -> Column:
    n = magnitude(a) * magnitude(b)
    return _guard(a, b, F.when(n > 0, _fold(a, b, lambda x, y: x * y) / n).otherwise(0.0), 0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _guard(a, b, _fold(a, b, lambda x, y: (x - y) * (x - y)), MAX_FLOAT)


def euclidean(a: Column, b: Column) -> Column:
    return _guard(a, b, F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y))), MAX_FLOAT)


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def manhattan(a: Column, b: Column) -> Column:
    return _guard(a, b, _fold(a, b, lambda x, y: F.abs(x - y)), MAX_FLOAT)


def hamming(a: Column, b: Column) -> Column:
    """How many signs differ; zero counts as positive."""
    differ = F.zip_with(_d(a), _d(b), lambda x, y: (x >= 0) != (y >= 0))
    return _guard(a, b, F.size(F.filter(differ, lambda x: x)).cast("double"), F.size(a).cast("double"))


def dimension(v: Column) -> Column:
    return F.when(v.isNull(), 0).otherwise(F.size(v))


def parse_metric(name: str | int | None) -> str:
    """The metric's name; unknown ones are cosine."""
    if isinstance(name, int):
        return next((m for m, n in METRICS.items() if n == name), "cosine")
    name = (name or "").lower()
    name = ALIASES.get(name, name)
    return name if name in METRICS else "cosine"


def distance(metric: str | int | None) -> Callable[[Column, Column], Column]:
    """What a search sorts by, ascending. The Euclidean metric is the squared distance."""
    return {
        "cosine": cosine_distance,
        "euclidean": squared_euclidean,
        "dot": dot_distance,
        "manhattan": manhattan,
        "hamming": hamming,
    }[parse_metric(metric)]


def score(metric: str | int | None, dist: Column) -> Column:
    """What a search reports: the distance, but for dot the product itself."""
    return -dist if parse_metric(metric) == "dot" else dist


def vector_literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")
