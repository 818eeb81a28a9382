"""Collections of vectors and the catalog that holds them."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import metrics as M
from ..functions.filters import Filter
from ..functions.quantize import code_distance, quantizer_of
from ..operators import graph as G
from ..operators import search as S
from ..runtime import checkpoint_dir
from .store import PUT, Files, Store, export_lines, import_lines

INPUT = "id string, values array<float>, metadata string"


class NotFound(KeyError):
    """No such collection or vector."""


class Exists(ValueError):
    """The collection is there already."""


@dataclass
class Config:
    name: str
    dimension: int
    metric: int = 0
    index_type: str = "hnsw"
    storage_type: str = "memory"
    data_dir: str = ""
    m: int = 16
    ef_construction: int = 200
    quantization: str = ""

    def check(self) -> None:
        if not self.name or not re.fullmatch(r"[\w .+-]+", self.name) or not self.name.strip(". "):
            raise ValueError("a collection needs a name of letters, digits, blanks and . + - _")
        if self.dimension <= 0:
            raise ValueError("a collection needs a dimension above 0")


def with_metric(metric: str):
    return lambda c: setattr(c, "metric", M.METRICS[M.parse_metric(metric)])


def with_graph_params(m: int, ef_construction: int):
    return lambda c: (setattr(c, "m", m), setattr(c, "ef_construction", ef_construction))


def with_quantization(kind: str):
    return lambda c: setattr(c, "quantization", kind)


class Collection:
    def __init__(self, spark: SparkSession, config: Config, path: str, created: float | None = None):
        config.check()
        self.spark, self.config, self.store = spark, config, Store(spark, f"{path}/data")
        self.created = created or time.time()

    @property
    def updated(self) -> float:
        """The time of the last change of the data."""
        return self.store.manifest["time"] or self.created

    name = property(lambda self: self.config.name)
    dimension = property(lambda self: self.config.dimension)
    metric = property(lambda self: M.parse_metric(self.config.metric))
    quantizer = property(lambda self: quantizer_of(self.config.quantization))

    def _frame(self, rows: DataFrame | list[dict]) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        data = [
            (r["id"], [float(v) for v in r["values"]] if r.get("values") is not None else None, json.dumps(r["metadata"]) if r.get("metadata") is not None else None)
            for r in rows
        ]
        return self.spark.createDataFrame(data, INPUT).coalesce(1)

    def insert(self, rows: DataFrame | list[dict]) -> int:
        """Put rows (id, values, metadata); all of them or, if one has a wrong dimension, none. Gives their number.

        The rows are evaluated once, checked as they were written, and hold from then on.
        """
        nameless = F.col("id").isNull()

        def check(written: DataFrame) -> None:
            wrong = (F.col("id") == "") | F.coalesce(F.size("values") != self.dimension, F.lit(True))
            if not written.where(wrong).isEmpty():
                raise ValueError(f"every vector needs an id and {self.dimension} values")

        df = self._frame(rows)
        return self.store.append(df.withColumn("op", F.lit(PUT)).withColumn("id", F.when(nameless, "").otherwise(F.col("id").cast("string"))), check=check)

    insert_batch = insert

    def current(self) -> DataFrame:
        return self.store.current()

    def get(self, id: str) -> Row:
        row = self.store.get(id).first()
        if row is None:
            raise NotFound(id)
        return row

    def delete(self, ids: str | list[str] | DataFrame) -> None:
        self.store.delete([ids] if isinstance(ids, str) else ids)

    def update(self, id: str, values: list[float] | None = None, metadata: dict | None = None) -> None:
        """Replace values, metadata or both; the version goes up by one. An unknown id is an error."""
        old = self.get(id)
        if values is not None and len(values) != self.dimension:
            raise ValueError(f"a vector needs {self.dimension} values")
        new = (id, [float(v) for v in values] if values is not None else old["values"], json.dumps(metadata) if metadata is not None else old.metadata, old.version + 1)
        self.store.put(self.spark.createDataFrame([new], INPUT + ", version bigint"))

    def count(self) -> int:
        return self.store.size()

    def search(
        self, query: list[float], k: int = 10, where: Filter | dict | str | None = None, mode: str = "pre", include: tuple[str, ...] = ("metadata",),
        ef: int = 0, rerank: bool = False, quantized: bool = False,
    ) -> DataFrame:
        """id, score and `include` of the k nearest vectors.

        quantized: the `ef` nearest (10 k at least) by the collection's quantiser are scored again exactly. rerank: the
        result is scored again from the full vectors and sorted; the dot metric's scores are then distances.
        """
        if len(query) != self.dimension:
            raise ValueError(f"a query needs {self.dimension} values")
        rows, k = self.current(), k if k > 0 else 10
        if quantized and self.quantizer:
            if where is not None:
                rows = rows.where(S.predicate(rows, where, "metadata"))
                where = None
            far, rows = code_distance(rows, "values", query, self.quantizer)
            rows = rows.withColumn("_code", far).orderBy("_code", "id").limit(max(ef, 10 * k))
        found = S.knn(rows, query, k, self.metric, where=where, metadata="metadata", mode=mode, include=list(include))
        if rerank:
            again = S.rerank(found, self.current(), query, self.metric)
            score = -F.col("score") if self.metric == "dot" else F.col("score")
            found = found.drop("score").join(again, "id").select("id", score.alias("score"), *include)
        return found

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return S.knn_batch(self.current(), queries, k, self.metric)

    def stats(self, links: bool = False) -> dict:
        """With `links` also the number of links of the index, for which it is built if need be."""
        c = self.config
        return {"name": c.name, "dimension": c.dimension, "count": self.count(), "metric": self.metric, "index_type": c.index_type,
                "created": self.created, "updated": self.updated, "index": G.index_stats(self.index() if links else None, self.current(), c.m, c.ef_construction, self.metric)}

    def index(self) -> DataFrame:
        """The links of the neighbour graph: src, dst, dist, layer. Built once for a state of the data and kept beside it."""
        files, folder = self.store.files, f"{self.store.path}/index-{self.store.number:012d}"
        if not files.exists(f"{folder}/_SUCCESS"):
            old = [n for n in files.folders(self.store.path) if n.startswith("index-")]
            G.layered_graph(self.current(), self.config.m, metric=self.metric).write.mode("overwrite").parquet(folder)
            for n in old:
                files.remove(f"{self.store.path}/{n}")
        return self.spark.read.parquet(folder)

    def graph(self, max_nodes: int = 0) -> DataFrame:
        return G.graph_data(self.index(), max_nodes, self.current())

    def export(self, path: str) -> None:
        """JSON lines in the folder `path`: the configuration in a file of its own, that sorts first, and the vectors, written in parallel."""
        rows = export_lines(self.current(), asdict(self.config)).where(F.get_json_object("value", "$.values").isNotNull())
        rows.write.mode("overwrite").text(path)
        self.store.files.create(f"{path.rstrip('/')}/0-config.json", json.dumps(asdict(self.config)) + "\n")

    def import_(self, path: str) -> int:
        return self.insert(import_lines(self.spark.read.text(path)))

    def compact(self) -> None:
        self.store.compact()

    def sync(self) -> None:
        self.store.sync()

    def close(self) -> None:
        self.store.close()


class Catalog:
    """Collections by name. Without a folder they live in a temporary one until the session ends."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.kept = spark, path is not None
        self.path = (path or f"{checkpoint_dir(spark)}/collections-{uuid.uuid4().hex}").rstrip("/")
        self.files, self.open_ = Files(spark), {}
        self.files.make(self.path)
        for name in self.files.folders(self.path):
            try:
                saved = json.loads(self.files.read(f"{self.path}/{name}/config.json") or "")
                config = Config(**{f.name: saved[f.name] for f in fields(Config) if f.name in saved})
                self.open_[name] = Collection(spark, config, f"{self.path}/{name}", saved.get("created"))
            except (ValueError, TypeError):
                continue  # unreadable or broken configurations are skipped

    @staticmethod
    def version() -> str:
        return __version__

    def create(self, name: str, dimension: int, *options) -> Collection:
        if name in self.open_:
            raise Exists(name)
        config = Config(name, dimension, storage_type="disk" if self.kept else "memory", data_dir=self.path if self.kept else "")
        for option in options:
            option(config)
        config.check()
        made = Collection(self.spark, config, f"{self.path}/{name}")
        self.files.create(f"{self.path}/{name}/config.json", json.dumps(asdict(config) | {"created": made.created}))
        self.open_[name] = made
        return made

    def get(self, name: str) -> Collection:
        if name not in self.open_:
            raise NotFound(name)
        return self.open_[name]

    def delete(self, name: str) -> None:
        self.get(name).close()
        del self.open_[name]
        self.files.remove(f"{self.path}/{name}")

    def list(self) -> list[str]:
        return sorted(self.open_)

    def insert(self, name: str, rows) -> int:
        return self.get(name).insert(rows)

    insert_batch = insert

    def get_vector(self, name: str, id: str) -> Row:
        return self.get(name).get(id)

    def delete_vector(self, name: str, ids: str | list[str] | DataFrame) -> None:
        self.get(name).delete(ids)

    def search(self, name: str, query: list[float], k: int = 10, where=None) -> DataFrame:
        return self.get(name).search(query, k, where)

    def close(self) -> None:
        for c in self.open_.values():
            c.close()
        self.open_.clear()
        if not self.kept:
            self.files.remove(self.path)
