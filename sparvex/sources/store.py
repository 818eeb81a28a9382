"""A vector store over files: an append-only change log with snapshots, and import and export.

Each append is one Parquet batch in its own folder. A manifest lists the snapshot and the batches that hold. Manifests
are numbered files that are created, never replaced: the readable one of the highest number holds, so a writer that
dies leaves the state before, and readers see whole states only. Of two writers that start from one state the second
gets a `Conflict` and may try again. The current rows are the last change of every id; deletes are tombstones. Paths may
be of any file system Spark can write.

A store is written either by plain batches, of which the later wins, or by changes that bring an order of their own
(`order`): then the change of the greatest order wins, however late it comes, and compaction keeps the tombstones.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = 0, 1
SPARSE = "struct<indices:array<bigint>,values:array<float>>"
_SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))])
SCHEMA = (
    T.StructType()
    .add("batch", T.LongType())
    .add("row", T.LongType())
    .add("op", T.IntegerType())
    .add("id", T.StringType())
    .add("values", T.ArrayType(T.FloatType()))
    .add("metadata", T.StringType())
    .add("sparse", _SPARSE)
    .add("version", T.LongType())
    .add("ts_ns", T.LongType())
    .add("at", T.LongType())
)
STATE = ["id", "values", "metadata", "sparse", "version", "ts_ns"]


class Conflict(RuntimeError):
    """Another writer was faster."""


class Files:
    """The few file operations that are needed, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file; `Conflict` if it is there already."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Conflict(path) from e
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Store:
    """put, get, delete, iterate, sync, compact and close over one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.files.make(self.path)

    def _state(self) -> tuple[int, dict]:
        """The number of the newest manifest file, and what the newest readable one says."""
        names = [n for n in self.files.names(self.path) if n.startswith("manifest-")]
        for n in reversed(names):
            try:
                return int(names[-1][9:21]), json.loads(self.files.read(f"{self.path}/{n}") or "")
            except ValueError:
                continue  # its writer died
        return int(names[-1][9:21]) if names else 0, {"snapshot": None, "batches": [], "next": 0, "ordered": None, "epochs": {}, "time": None}

    @property
    def manifest(self) -> dict:
        return self._state()[1]

    @property
    def number(self) -> int:
        """The number of the state; each change makes it greater."""
        return self._state()[0]

    def _commit(self, number: int, m: dict) -> None:
        """Make `m` the state after manifest `number`; the one before stays for readers that have begun."""
        m["time"] = time.time()
        self.files.create(f"{self.path}/manifest-{number + 1:012d}.json", json.dumps(m))
        for n in self.files.names(self.path):
            if n.startswith("manifest-") and int(n[9:21]) < number:
                self.files.remove(f"{self.path}/{n}")

    def append(self, changes: DataFrame, order: str | None = None, check: Callable[[DataFrame], None] | None = None, epoch: tuple[str, int] | None = None) -> int:
        """Append puts and deletes: op, id and any of values, metadata, sparse, version, ts_ns. Later rows win, or those of
        the greater `order` (a column; null is the lowest). Rows without an id are left out. Gives their number.

        `changes` is evaluated once; without `order` or a `row` column it must keep its row order (one partition).
        `check` gets the written rows and may refuse them. An `epoch` (name, number) that was appended before is skipped.
        """
        number, m = self._state()
        if epoch and m["epochs"].get(epoch[0], -1) >= epoch[1]:
            return 0
        if m["ordered"] is not None and m["ordered"] != (order is not None):
            raise ValueError("changes with an order of their own and plain batches do not mix")
        columns = dict(changes.dtypes)
        rows = changes.where(F.col("id").isNotNull())
        fill = {
            "batch": F.lit(m["next"]),
            "row": F.col("row") if "row" in columns else F.monotonically_increasing_id(),
            "op": F.col("op") if "op" in columns else F.lit(PUT),
            "version": F.coalesce(F.col("version"), F.lit(1)) if "version" in columns else F.lit(1),
            "ts_ns": F.coalesce(F.col("ts_ns"), F.lit(time.time_ns())) if "ts_ns" in columns else F.lit(time.time_ns()),
            "at": F.col(order) if order else F.lit(None),
        }
        rows = rows.select(*((fill.get(f.name) if f.name in fill else F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA))
        name = f"batch-{m['next']:012d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")
        try:
            if check:
                check(written)
            m["batches"].append(name)
            m["next"] += 1
            m["ordered"] = order is not None
            if epoch:
                m["epochs"][epoch[0]] = epoch[1]
            self._commit(number, m)
        except Exception:
            self.files.remove(f"{self.path}/{name}")
            raise
        return written.count()

    def log(self) -> DataFrame:
        """All changes that hold, with those of the snapshot as batch -1."""
        m = self.manifest
        paths = [f"{self.path}/{n}" for n in [m["snapshot"], *m["batches"]] if n]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _last(self, log: DataFrame) -> DataFrame:
        """The last change of each id, reduced on the map side first."""
        last = F.max_by(F.struct("op", *STATE[1:], "at"), F.struct("at", "batch", "row")).alias("r")
        return log.groupBy("id").agg(last).select("id", "r.*")

    def current(self) -> DataFrame:
        """The live rows."""
        return self._last(self.log()).where(F.col("op") == PUT).select(*STATE)

    def put(self, rows: DataFrame) -> None:
        self.append(rows.withColumn("op", F.lit(PUT)))

    def get(self, id: str) -> DataFrame:
        return self._last(self.log().where(F.col("id") == id)).where(F.col("op") == PUT).select(*STATE)  # the id reaches the scan

    def delete(self, ids: DataFrame | list[str]) -> None:
        """Unknown ids are no error."""
        rows = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        self.append(rows.select("id", F.lit(DELETE).alias("op")))

    def iterate(self) -> Iterator:
        return self.current().toLocalIterator()

    def size(self) -> int:
        return self.current().count()

    def sync(self) -> None:
        """Appends are durable once they return."""

    def compact(self) -> None:
        """Write the live rows as a new snapshot, sorted by id so that a search for one reads few row groups, switch to it,
        remove the old files. With changes that may still come late, tombstones are live."""
        number, m = self._state()
        name = f"snapshot-{m['next']:012d}-{uuid.uuid4().hex[:8]}"
        last = self._last(self.log())
        if not m["ordered"]:
            last = last.where(F.col("op") == PUT)
        rows = last.select(F.lit(-1).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("row"), "op", *STATE, "at")
        rows.select(*SCHEMA.names).sortWithinPartitions("id").write.parquet(f"{self.path}/{name}")
        try:
            self._switch(number, m, name)
        except Conflict:
            self.files.remove(f"{self.path}/{name}")
            raise

    def _switch(self, number: int, m: dict, snapshot: str | None) -> None:
        old = [n for n in [m["snapshot"], *m["batches"]] if n]
        self._commit(number, m | {"snapshot": snapshot, "batches": []})
        for n in old:
            self.files.remove(f"{self.path}/{n}")

    def truncate(self) -> None:
        number, m = self._state()
        self._switch(number, m | {"ordered": None}, None)

    def close(self) -> None:
        pass


def export_lines(current: DataFrame, config: dict) -> DataFrame:
    """One text column `value`: one vector per line, in no order, and the configuration."""
    fields = [F.col("id"), F.col("values"), F.try_parse_json("metadata").alias("metadata"), F.col("sparse"), F.col("version"), F.col("ts_ns")]
    head = current.sparkSession.createDataFrame([(json.dumps(config),)], "value string")
    return head.unionByName(current.select(F.to_json(F.struct(*fields)).alias("value")))


_CODEC = "id string, values array<float>"


def encoded(vectors: DataFrame) -> DataFrame:
    """id, data: the binary form of every vector, by Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [serialize(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    rows = vectors.where(F.col("id").isNotNull() & F.col("values").isNotNull())
    return rows.select("id", F.col("values").cast("array<float>")).mapInArrow(run, "id string, data binary")


def decoded(data: DataFrame) -> DataFrame:
    """id, values from a column `data` of binary forms; a form that ends too early is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [deserialize(d) for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["id", "values"])

    return data.where(F.col("data").isNotNull()).select("data").mapInArrow(run, _CODEC)


def import_lines(text: DataFrame) -> DataFrame:
    """The vectors of exported lines; the configuration and lines that are no vector are skipped."""
    kind = f"id string, values array<float>, sparse {SPARSE}, version bigint, ts_ns bigint"
    rows = text.select(F.from_json("value", kind).alias("r"), F.get_json_object("value", "$.metadata").alias("metadata"))
    return rows.where(F.col("r.id").isNotNull() & F.col("r.values").isNotNull()).select("r.*", "metadata")


def serialize(id: str, values: list[float]) -> bytes:
    """The binary form of a dense vector: id length, id, count, 32-bit floats, all little endian."""
    name = id.encode()
    return struct.pack("<I", len(name)) + name + struct.pack("<I", len(values)) + np.asarray(values, "<f4").tobytes()


def deserialize(data: bytes) -> tuple[str, list[float]]:
    try:
        (n,) = struct.unpack_from("<I", data)
        (count,) = struct.unpack_from("<I", data, 4 + n)
        if len(data) < 8 + n + 4 * count:
            raise ValueError("the data end too early")
        return data[4 : 4 + n].decode(), np.frombuffer(data, "<f4", count, 8 + n).tolist()
    except struct.error as e:
        raise ValueError("the data end too early") from e
