import json

import pytest
from pyspark.sql import functions as F

from sparvex.api.server import handle
from sparvex.sources.catalog import Catalog, Exists, NotFound, with_graph_params, with_metric, with_quantization
from sparvex.sources.store import Conflict, Store, deserialize, export_lines, import_lines, serialize
from sparvex.streaming.upserts import apply_changes, windowed_counts

ROW = "id string, values array<float>, metadata string"


def test_log_and_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.size() == 0
    s.put(spark.createDataFrame([(f"v{i}", [float(i)], None) for i in range(100)], ROW))
    s.put(spark.createDataFrame([("v1", [9.0], '{"a":1}'), ("v1", [8.0], None), (None, [1.0], None)], ROW).coalesce(1))
    s.delete([f"v{i}" for i in range(50, 100)] + ["unknown"])
    assert s.size() == 50 and s.get("v1").first()["values"] == [8.0] and s.get("v60").first() is None
    before = sorted(map(tuple, s.current().collect()), key=str)
    s.compact()
    assert len(s.manifest["batches"]) == 0 and sorted(map(tuple, s.current().collect()), key=str) == before
    again = Store(spark, str(tmp_path / "s"))
    again.put(spark.createDataFrame([("v1", [7.0], None)], ROW))
    assert again.size() == 50 and again.get("v1").first()["values"] == [7.0]
    again.truncate()
    assert again.size() == 0


def test_codec_and_lines(spark):
    assert deserialize(serialize("é-1", [1.5, -2.0])) == ("é-1", [1.5, -2.0])
    with pytest.raises(ValueError):
        deserialize(serialize("x", [1.0])[:-1])
    s = "id string, values array<float>, metadata string, sparse struct<indices:array<bigint>,values:array<float>>, version bigint, ts_ns bigint"
    df = spark.createDataFrame([("a", [1.0], '{"k": [1, "x"]}', ([3], [0.5]), 4, 9), ("b", [2.0], None, None, 1, 1)], s)
    lines = export_lines(df, {"name": "n", "metric": 1})
    assert {"name": "n", "metric": 1} in [json.loads(r.value) for r in lines.collect()]
    back = {r.id: r for r in import_lines(lines.union(spark.createDataFrame([("broken {",)], "value string"))).collect()}
    assert set(back) == {"a", "b"} and json.loads(back["a"].metadata) == {"k": [1, "x"]} and back["a"].sparse.indices == [3] and back["a"].version == 4


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Catalog(spark, path)
    c = db.create("docs", 2, with_metric("l2"), with_graph_params(8, 50), with_quantization("sq8"))
    with pytest.raises(Exists):
        db.create("docs", 2)
    for bad in (("", 2), ("x", 0)):
        with pytest.raises(ValueError):
            db.create(*bad)
    rows = [{"id": f"v{i}", "values": [i, 0], "metadata": {"n": i, "even": i % 2 == 0}} for i in range(20)]
    assert c.insert(rows) == 20 and c.quantizer == "sq8"
    with pytest.raises(ValueError):
        c.insert([{"id": "ok", "values": [1, 2]}, {"id": "bad", "values": [1]}])
    assert c.count() == 20
    assert [r.id for r in c.search([3, 0], 3).collect()] == ["v3", "v2", "v4"]
    assert [r.id for r in db.search("docs", [3, 0], 2, {"even": True}).collect()] == ["v2", "v4"]
    c.update("v3", metadata={"n": -1})
    assert c.get("v3").version == 2 and list(c.get("v3")["values"]) == [3.0, 0.0]
    with pytest.raises(NotFound):
        c.update("none", [1, 2])
    c.delete(["v4", "none"])
    assert c.count() == 19
    c.compact()
    again = Catalog(spark, path)
    assert again.list() == ["docs"] and again.get("docs").count() == 19 and again.get("docs").stats()["metric"] == "euclidean"
    again.get("docs").export(str(tmp_path / "out"))
    other = again.create("copy", 2)
    assert other.import_(str(tmp_path / "out")) == 19 and other.graph(5).count() == 5
    again.delete("copy")
    with pytest.raises(NotFound):
        again.get("copy")
    (tmp_path / "db" / "broken").mkdir()
    (tmp_path / "db" / "broken" / "config.json").write_text("{")
    assert Catalog(spark, path).list() == ["docs"]
    again.close()
    assert again.list() == []


def test_http(spark):
    db = Catalog(spark)
    call = lambda m, u, b=None: handle(db, m, u, json.dumps(b).encode() if b is not None else b"")
    assert call("GET", "/health") == (200, {"status": "healthy"}) and call("GET", "/version")[0] == 200
    assert call("POST", "/collections", {"name": "c", "dimension": 4, "metric": "cosine"})[0] == 201
    assert call("POST", "/collections", {"name": "c", "dimension": 4})[0] == 409 and call("POST", "/collections", {"name": "", "dimension": 4})[0] == 400
    assert handle(db, "POST", "/collections", b"{")[0] == 400 and call("PUT", "/collections")[0] == 405
    v = [{"id": i, "values": x, "metadata": {"category": k}} for i, x, k in (("v1", [1, 0, 0, 0], "a"), ("v2", [0.9, 0.1, 0, 0], "b"), ("v3", [0, 1, 0, 0], "a"))]
    assert call("POST", "/collections/c/vectors", {"vectors": v}) == (201, {"inserted": 3})
    assert call("POST", "/collections/c/vectors", {"vectors": []})[0] == 400 and call("POST", "/collections/none/vectors", {"vectors": v})[0] in (400, 404)
    assert call("GET", "/collections/c")[1]["count"] == 3 and call("GET", "/collections/none")[0] == 404
    found = call("POST", "/collections/c/search", {"vector": [1, 0, 0, 0], "k": 2, "filter": {"category": "a"}})[1]["results"]
    assert [r["id"] for r in found] == ["v1", "v3"]
    assert call("POST", "/collections/c/search", {"vector": []})[0] == 400 and call("POST", "/collections/none/search", {"vector": [1]})[0] == 400
    assert call("POST", "/collections/c/search", {"vector": [1, 0, 0, 0], "filter": {"$and": 1}})[0] == 400
    assert call("GET", "/collections/c/vectors?id=v1")[1]["metadata"] == {"category": "a"} and call("GET", "/collections/c/vectors")[0] == 400
    assert call("GET", "/collections/c/vectors?id=zz")[0] == 404 and call("DELETE", "/collections/c/vectors?id=zz")[0] == 200
    assert len(call("GET", "/collections/c/graph?max_nodes=2")[1]["nodes"]) == 2 and call("OPTIONS", "/x")[0] == 204 and call("GET", "/x/y/z")[0] == 404
    assert call("DELETE", "/collections/c")[0] == 200 and call("DELETE", "/collections/c")[0] == 404
    db.close()


def test_stream_equals_batch(spark, tmp_path):
    kind = "seq bigint, op int, id string, values array<float>, metadata string"
    rows = [(n, int(n % 7 == 0), f"v{n % 11}", [float(n)], None) for n in range(60)]
    df = spark.createDataFrame(rows, kind)
    for i in range(3):
        df.where((F.col("seq") >= 20 * i) & (F.col("seq") < 20 * i + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "st"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    apply_changes(stream, store, str(tmp_path / "cp")).awaitTermination()
    last = {}
    for _, op, id, v, _ in rows:
        last[id] = None if op else v
    assert {r.id: r["values"] for r in store.current().collect()} == {k: v for k, v in last.items() if v is not None}
    w = windowed_counts(spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "no") if (tmp_path / "no").mkdir() else str(tmp_path / "no")), "t", ["k"])
    assert w.isStreaming and w.columns == ["window_start", "k", "n"]


def test_writers_that_die_or_meet(spark, tmp_path):
    path = tmp_path / "s"
    s = Store(spark, str(path))
    rows = lambda *ids: spark.createDataFrame([(i, [1.0], None) for i in ids], ROW)
    s.put(rows("a", "b"))
    number, m = s._state()
    (path / f"manifest-{number + 1:012d}.json").write_text('{"snapsh')  # a writer died while it wrote
    assert Store(spark, str(path)).size() == 2
    s.put(rows("c"))
    assert s.size() == 3 and s.number == number + 2
    other = Store(spark, str(path))
    number, m = other._state()
    s.put(rows("d"))
    with pytest.raises(Conflict):  # the other started from the state before
        other._commit(number, m)
    assert sorted(r.id for r in s.current().collect()) == ["a", "b", "c", "d"]
    before = set(p.name for p in path.iterdir() if p.is_dir())
    with pytest.raises(ValueError):
        s.append(rows("e"), check=lambda written: (_ for _ in ()).throw(ValueError(written.count())))
    assert set(p.name for p in path.iterdir() if p.is_dir()) == before and s.size() == 4
    with pytest.raises(ValueError):
        s.append(rows("f").withColumn("seq", F.lit(1)), order="seq")


def test_late_changes_lose(spark, tmp_path):
    """A change of a later batch that is older by its own order, before and after compaction; a new query begins anew."""
    kind = "seq bigint, op int, id string, values array<float>, metadata string"
    s = Store(spark, str(tmp_path / "s"))
    for rows in ([(10, 0, "a", [10.0], None), (11, 1, "b", None, None)], [(5, 0, "a", [5.0], None), (6, 0, "b", [6.0], None)]):
        s.append(spark.createDataFrame(rows, kind), order="seq")
        s.compact()
    assert [(r.id, list(r["values"])) for r in s.current().collect()] == [("a", [10.0])]
    for n, folder in enumerate(("one", "two")):  # the same source with another checkpoint: another query
        spark.createDataFrame([(20 + n, 0, folder, [float(n)], None)], kind).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        apply_changes(stream, s, str(tmp_path / folder)).awaitTermination()
    assert {r.id for r in s.current().collect()} == {"a", "one", "two"}
    again = s.append(spark.createDataFrame([(99, 0, "z", [1.0], None)], kind), order="seq", epoch=("q", 3))
    assert again == 1 and s.append(spark.createDataFrame([(100, 0, "y", [1.0], None)], kind), order="seq", epoch=("q", 3)) == 0


def test_searches_by_quantisers(spark, tmp_path):
    db = Catalog(spark, str(tmp_path / "db"))
    rows = [{"id": f"v{i:02d}", "values": [float((i * 7 + j * 3) % 11) - 5 for j in range(8)], "metadata": {"n": i}} for i in range(40)]
    for kind in ("sq8", "pq", "binary"):
        c = db.create(kind, 8, with_metric("l2"), with_quantization(kind))
        c.insert(rows)
        exact = [r.id for r in c.search(rows[3]["values"], 5).collect()]
        assert [r.id for r in c.search(rows[3]["values"], 5, ef=40, quantized=True).collect()] == exact
        some = c.search(rows[3]["values"], 5, {"n": {"$lt": 20}}, quantized=True).collect()
        assert [r.id for r in some] == [r.id for r in c.search(rows[3]["values"], 5, {"n": {"$lt": 20}}).collect()]
    assert c.stats(links=True)["index"]["total_connections"] > 0 and c.updated > c.created
    with pytest.raises(ValueError):
        db.create("../x", 2)
