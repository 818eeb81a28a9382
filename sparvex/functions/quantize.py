"""Scalar (8 bit), product and binary quantisation of vectors.

Scalar: per-dimension range; codes are cut off, not rounded. Untrained, values are taken from [-1, 1]. Product:
one k-means of 256 words per subspace, started from the first rows by id, ten rounds. Binary: a bit for each value
above 0, the lowest bit of each byte first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, ROUNDS, SAMPLE_ROWS = 256, 10, 65_536
#: The names that choose a quantiser in a collection's configuration.
QUANTIZERS = {"scalar": "sq8", "sq8": "sq8", "pq": "pq", "product": "pq", "binary": "binary"}


def quantizer_of(name: str | None) -> str | None:
    return QUANTIZERS.get((name or "").lower())


def sq8_train(df: DataFrame, vector: str) -> DataFrame:
    """pos, low, high, scale: one row per dimension. Null vectors and elements don't count."""
    e = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).where(F.col("x").isNotNull())
    r = e.groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return r.withColumn("scale", F.when(F.col("high") > F.col("low"), 255.0 / (F.col("high") - F.col("low"))).otherwise(1.0))


def sq8_model(trained: DataFrame) -> DataFrame:
    """One row: lows, highs, scales in the order of the dimensions."""
    r = F.array_sort(F.collect_list(F.struct("pos", "low", "high", "scale")))
    m = trained.agg(r.alias("r"))
    return m.select(*(F.col("r").getField(c).alias(c + "s") for c in ("low", "high", "scale")))


def sq8_encode(v: Column, lows: Column | None = None, highs: Column | None = None, scales: Column | None = None) -> Column:
    v = v.cast("array<double>")
    if lows is None:
        return F.transform(v, lambda x: F.floor((F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) + 1) * 127.5).cast("smallint"))
    z = F.arrays_zip(v.alias("v"), lows.alias("l"), highs.alias("h"), scales.alias("s"))
    code = lambda e: F.floor((F.least(F.greatest(e["v"], e["l"]), e["h"]) - e["l"]) * e["s"])
    return F.transform(z, lambda e: F.least(F.greatest(code(e), F.lit(0)), F.lit(255)).cast("smallint"))


def sq8_decode(q: Column, lows: Column | None = None, scales: Column | None = None) -> Column:
    if lows is None:
        return F.transform(q, lambda x: x / 127.5 - 1)
    return F.transform(F.arrays_zip(q.alias("q"), lows.alias("l"), scales.alias("s")), lambda e: e["q"] / e["s"] + e["l"])


def binary_encode(v: Column) -> Column:
    """Bytes as small integers."""
    bits = F.transform(v.cast("array<double>"), lambda x: F.when(x > 0, 1).otherwise(0))
    size = F.ceil(F.size(v) / 8).cast("int")
    byte = lambda b: F.aggregate(
        F.sequence(F.lit(0), F.lit(7)),
        F.lit(0),
        lambda s, i: s + F.coalesce(F.get(bits, b * 8 + i), F.lit(0)) * F.pow(F.lit(2), i).cast("int"),
    )
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda b: byte(b).cast("smallint"))).otherwise(F.array().cast("array<smallint>"))


def binary_decode(codes: Column, dim: Column | int) -> Column:
    n = dim if isinstance(dim, Column) else F.lit(dim)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(F.floor(F.get(codes, F.floor(i / 8).cast("int")) / F.pow(F.lit(2), i % 8)) % 2 == 1, 1.0).otherwise(-1.0),
    )


def binary_distance(a: Column, b: Column) -> Column:
    """How many bits differ."""
    both = F.zip_with(a.cast("array<int>"), b.cast("array<int>"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(both, F.lit(0), lambda s, x: s + x)


def kmeans(x: np.ndarray, k: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Started from the first k rows (zeros beyond); the lowest number wins ties; an empty cluster stays."""
    c = np.zeros((k, x.shape[1]))
    c[: len(x)] = x[:k]
    for _ in range(rounds):
        near = np.argmin(((x[:, None] - c[None]) ** 2).sum(2), 1) if len(x) * k * x.shape[1] < 5e7 else _nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)])


def pq_train(df: DataFrame, id_col: str, vector: str, subspaces: int, words: int = WORDS) -> DataFrame:
    """subspace, words (array of vectors): one code book per subspace, each trained in its own task.

    Trained on at most about SAMPLE_ROWS rows, chosen by id hash. Null vectors don't count. A subspace that
    begins beyond the end of the vectors is empty.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    if n > SAMPLE_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * SAMPLE_ROWS / n))
    width = F.ceil(F.size("v") / subspaces).cast("int")
    s = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(subspaces - 1))).alias("subspace"))
    s = s.select("id", "subspace", F.slice("v", F.col("subspace") * width + 1, width).alias("part"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack([np.asarray(p, float) for p in pdf["part"]])
        return pd.DataFrame({"subspace": [pdf["subspace"].iloc[0]], "words": [list(map(list, kmeans(x, words)))]})

    return s.groupBy("subspace").applyInPandas(fit, "subspace int, words array<array<double>>")


def _books(trained: DataFrame) -> list[np.ndarray]:
    """The code books: as many numbers as 256 vectors."""
    return [np.array(r.words, float).reshape(len(r.words), -1) for r in trained.orderBy("subspace").collect()]


def pq_encode(df: DataFrame, vector: str, trained: DataFrame, out: str = "codes") -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(_books(trained))

    @F.pandas_udf("array<smallint>")
    def encode(v: pd.Series) -> pd.Series:
        books, good = sent.value, v.notna()
        x = np.stack([np.asarray(e, float) for e in v[good]]) if good.any() else np.zeros((0, 1))
        width, codes = -(-x.shape[1] // len(books)), []
        for i, c in enumerate(books):
            part = x[:, i * width : (i + 1) * width]
            codes.append(_nearest(part, c[:, : part.shape[1]]) if part.shape[1] else np.zeros(len(x), int))
        result = pd.Series([None] * len(v), index=v.index, dtype=object)
        for at, row in zip(v.index[good], np.stack(codes, 1).tolist() if len(x) else []):
            result[at] = row
        return result

    return df.withColumn(out, encode(vector))


def pq_decode(df: DataFrame, codes: str, trained: DataFrame, out: str = "decoded") -> DataFrame:
    """Concatenated words, from the code books as one small literal row."""
    books = trained.agg(F.transform(F.array_sort(F.collect_list(F.struct("subspace", "words"))), lambda b: b["words"]).alias("_books"))
    joined = df.crossJoin(F.broadcast(books))  # one row of 256 vectors
    pieces = F.zip_with(F.col(codes), F.col("_books"), lambda c, b: F.get(b, c.cast("int")))
    return joined.withColumn(out, F.flatten(pieces)).drop("_books")


def pq_tables(query: list[float], books: list[np.ndarray]) -> list[list[float]]:
    """The squared distances of a query's parts to the words of each subspace."""
    q, width = np.asarray(query, float), -(-len(query) // max(1, len(books)))
    parts = [q[i * width : (i + 1) * width] for i in range(len(books))]
    return [((c[:, : len(p)] - p) ** 2).sum(1).tolist() for p, c in zip(parts, books)]


def pq_distance(codes: Column, query: list[float], trained: DataFrame) -> Column:
    """The squared distance of a query and codes, by table look-ups: a sum of one entry per subspace. Untrained: the greatest float."""
    books = _books(trained)
    if not books:
        return F.lit(float(np.finfo(np.float32).max))
    tables = F.array(*[F.array(*map(F.lit, t)) for t in pq_tables(query, books)])
    entries = F.zip_with(codes, tables, lambda c, t: F.get(t, c.cast("int")))
    return F.aggregate(entries, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def code_distance(df: DataFrame, vector: str, query: list[float], kind: str) -> tuple[Column, DataFrame]:
    """The distance of a query and the codes of the quantiser `kind`, and the rows with what it needs."""
    q = F.array(*map(F.lit, map(float, query)))
    v = F.col(vector)
    if kind == "binary":
        return binary_distance(binary_encode(v), binary_encode(q)), df
    if kind == "sq8":
        model = sq8_model(sq8_train(df, vector))  # one row
        df = df.crossJoin(F.broadcast(model))
        decoded = sq8_decode(sq8_encode(v, F.col("lows"), F.col("highs"), F.col("scales")), F.col("lows"), F.col("scales"))
        return F.aggregate(F.zip_with(decoded, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), df
    book = pq_train(df, "id", vector, max(1, len(query) // 8))
    return pq_distance(F.col("_pq"), query, book), pq_encode(df, vector, book, "_pq")
