"""A REST adapter over a catalog, on the standard library's server.

    python -m sparvex.api.server --addr :8080 --data FOLDER
"""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from ..functions.filters import parse
from ..operators.graph import entry_point
from ..sources.catalog import Catalog, NotFound, with_graph_params, with_metric, with_quantization

GRAPH_NODES, MOST_GRAPH_NODES = 100, 10_000


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def handle(catalog: Catalog, method: str, url: str, body: bytes = b"") -> tuple[int, dict | None]:
    """Status and JSON answer of a request."""
    split = urlsplit(url)
    parts, query = [p for p in split.path.split("/") if p], parse_qs(split.query)
    try:
        if method == "OPTIONS":
            return 204, None
        if parts == ["health"]:
            return 200, {"status": "healthy"}
        if parts == ["version"]:
            return 200, {"version": catalog.version()}
        if parts == ["collections"]:
            if method == "GET":
                return 200, {"collections": catalog.list()}
            if method == "POST":
                return 201, _create(catalog, _object(body))
            raise Refused(405, "method not allowed")
        if len(parts) == 2 and parts[0] == "collections":
            if method == "GET":
                return 200, catalog.get(parts[1]).stats(links=query.get("links") == ["true"])
            if method == "DELETE":
                catalog.delete(parts[1])
                return 200, {"status": "deleted"}
            raise Refused(405, "method not allowed")
        if len(parts) == 3 and parts[0] == "collections":
            return _operate(catalog, parts[1], parts[2], method, query, body)
        raise Refused(404, "not found")
    except Refused as e:
        return e.status, {"error": str(e)}
    except NotFound as e:
        return 404, {"error": f"not found: {e.args[0]}"}


def _object(body: bytes) -> dict:
    try:
        obj = json.loads(body)
    except ValueError as e:
        raise Refused(400, f"bad JSON: {e}") from e
    if not isinstance(obj, dict):
        raise Refused(400, "a JSON object is needed")
    return obj


def _create(catalog: Catalog, r: dict) -> dict:
    name, dimension = r.get("name") or "", r.get("dimension") or 0
    if not name or not isinstance(dimension, int) or dimension <= 0:
        raise Refused(400, "a name and a dimension above 0 are needed")
    options = [with_metric(r["metric"])] if r.get("metric") else []
    if (r.get("m") or 0) > 0 and (r.get("ef_construction") or 0) > 0:
        options.append(with_graph_params(r["m"], r["ef_construction"]))
    if r.get("quantization"):
        options.append(with_quantization(r["quantization"]))
    try:
        catalog.create(name, dimension, *options)
    except ValueError as e:
        raise Refused(409, str(e)) from e
    return {"name": name, "dimension": dimension}


def _operate(catalog: Catalog, name: str, what: str, method: str, query: dict, body: bytes) -> tuple[int, dict]:
    if what == "vectors":
        if method == "POST":
            vectors = _object(body).get("vectors") or []
            if not vectors:
                raise Refused(400, "no vectors")
            try:
                return 201, {"inserted": catalog.insert(name, vectors)}
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                raise Refused(400, str(e)) from e
        if method not in ("GET", "DELETE"):
            raise Refused(405, "method not allowed")
        if not query.get("id"):
            raise Refused(400, "an id is needed")
        c = catalog.get(name)
        if method == "DELETE":
            c.delete(query["id"][0])
            return 200, {"status": "deleted"}
        v = c.get(query["id"][0])
        return 200, {"id": v.id, "values": list(v["values"]), "metadata": json.loads(v.metadata or "{}"), "version": v.version, "timestamp": v.ts_ns}
    if what == "search":
        if method != "POST":
            raise Refused(405, "method not allowed")
        r = _object(body)
        if not r.get("vector"):
            raise Refused(400, "a vector is needed")
        try:
            c = catalog.get(name)
            found = c.search(r["vector"], r.get("k") or 10, parse(r.get("filter")), ef=int(r.get("ef") or 0), rerank=bool(r.get("rerank"))).collect()
        except (ValueError, NotFound) as e:
            raise Refused(400, str(e)) from e
        return 200, {"results": [{"id": x.id, "score": x.score, "metadata": json.loads(x.metadata or "{}")} for x in found]}
    if what == "graph":
        if method != "GET":
            raise Refused(405, "method not allowed")
        asked = (query.get("max_nodes") or [""])[0]
        n = min(int(asked), MOST_GRAPH_NODES) if asked.isdigit() and int(asked) > 0 else GRAPH_NODES
        c = catalog.get(name)
        top = entry_point(c.current()).first()
        nodes = [{"id": r.id, "vector_id": r.id, "layer": r.layer, "max_layer": r.layer, "connections": list(r.links)} for r in c.graph(n).collect()]
        return 200, {"nodes": nodes, "total_nodes": top["size"], "max_layer": top.max_layer or 0, "entry_point": top.entry_point or ""}
    raise Refused(404, "not found")


def serve(catalog: Catalog, host: str = "", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, answer = handle(catalog, self.command, self.path, body)
            data = b"" if answer is None else json.dumps(answer).encode()
            self.send_response(status)
            for k, v in (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "GET, POST, DELETE, OPTIONS"), ("Access-Control-Allow-Headers", "Content-Type"), ("Content-Type", "application/json"), ("Content-Length", str(len(data)))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = do_OPTIONS = do_PUT = answer

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--addr", default=":8080")
    p.add_argument("--data")
    p.add_argument("--version", action="store_true")
    a = p.parse_args()
    if a.version:
        print(Catalog.version())
        return
    from pyspark.sql import SparkSession

    host, _, port = a.addr.rpartition(":")
    catalog = Catalog(SparkSession.builder.appName("sparvex").getOrCreate(), a.data)
    server = serve(catalog, host, int(port))
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        catalog.close()


if __name__ == "__main__":
    main()
