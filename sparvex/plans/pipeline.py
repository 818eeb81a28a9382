"""Queries p1 and p5: attribute history and change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changefeed import current_state
from ..operators.history import attribute_history
from ..runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coll_name, id, valid_from, valid_to: the periods of every vector's metadata."""
    return attribute_history(table(spark, sf_dir, "vector_versions"), contents=False).select("coll_name", "id", "valid_from", "valid_to")


def p1_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods with their attributes, as sorted texts "attribute=value"."""
    h = attribute_history(table(spark, sf_dir, "vector_versions"))
    plain = lambda text: F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    one = lambda e: F.concat(plain(F.concat(F.lit('"'), e["key"], F.lit('"'))), F.lit("="), F.coalesce(plain(e["value"]), F.lit("null")))
    return h.select("coll_name", "id", "valid_from", "valid_to", F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), one)), "|").alias("attrs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coll_name, id, entry_no: the live vectors and the entry that decided."""
    return current_state(table(spark, sf_dir, "wal_entries"), contents=False).select("coll_name", "id", "entry_no")


def p5_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live vectors with their values and metadata."""
    return current_state(table(spark, sf_dir, "wal_entries")).select("coll_name", "id", "vec_values", "metadata")


def p5_on_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed on a base, which holds before every entry: a row of its own for every vector of the feed and of `vectors`."""
    names = table(spark, sf_dir, "wal_entries").select("coll_name", "id").union(table(spark, sf_dir, "vectors").select("coll_name", "id")).distinct()
    base = names.select("coll_name", "id", F.lit(None).cast("array<float>").alias("vec_values"), F.lit('{"base":1}').alias("metadata"))
    return current_state(table(spark, sf_dir, "wal_entries"), base).select("coll_name", "id", "entry_no", "metadata")


QUERIES = {"p5_on_base": p5_on_base, "p1_found": p1_found, "p1_history": p1_history, "p5_found": p5_found, "p5_state": p5_state}

_LIVE = """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY coll_name, id ORDER BY ts DESC, entry_no DESC) AS rn
    FROM wal_entries WHERE op IN (0, 1) AND id IS NOT NULL AND coll_name IS NOT NULL AND ts IS NOT NULL)
  WHERE rn = 1 AND op = 0"""

_STATES = """
  WITH ok AS (
    SELECT coll_name, id, obs_id, coalesce(vec_version, -9223372036854775808) AS v,
      CASE WHEN abs(vec_ts) < 100000000000 THEN vec_ts * 1000000000 WHEN abs(vec_ts) < 100000000000000 THEN vec_ts * 1000000
        WHEN abs(vec_ts) < 100000000000000000 THEN vec_ts * 1000 ELSE vec_ts END AS t,
      CASE WHEN trim(metadata) <> 'null' THEN metadata END AS m
    FROM vector_versions WHERE coll_name IS NOT NULL AND id IS NOT NULL AND vec_ts IS NOT NULL),
  good AS (SELECT * FROM ok WHERE m IS NULL OR CASE WHEN json_valid(m) THEN json_type(m) = 'OBJECT' ELSE FALSE END),
  flat AS (
    SELECT g.obs_id, list_sort(list({'path': j.fullkey, 'kind': CASE WHEN j.type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN 'NUMBER' ELSE j.type END,
      'x': CASE WHEN j.type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN (j.atom::DOUBLE)::VARCHAR WHEN j.type IN ('OBJECT', 'ARRAY') THEN '' ELSE j.atom::VARCHAR END}))::VARCHAR AS state
    FROM good g, json_tree(g.m) j WHERE g.m IS NOT NULL GROUP BY g.obs_id),
  best AS (
    SELECT coll_name, id, t, state, m FROM good LEFT JOIN flat USING (obs_id)
    QUALIFY row_number() OVER (PARTITION BY coll_name, id, t ORDER BY v DESC, m IS NOT NULL DESC, state DESC) = 1),
  differ AS (
    SELECT *, lag(state) OVER (PARTITION BY coll_name, id ORDER BY t) AS before FROM best WHERE state IS NOT NULL)
  SELECT coll_name, id, t AS valid_from, coalesce(lead(t) OVER (PARTITION BY coll_name, id ORDER BY t), -1) AS valid_to{attrs}
  FROM differ WHERE before IS NULL OR before <> state"""
_KINDS = "('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE')"
_PLAIN = "regexp_replace((({x} ->> '$')::DOUBLE)::VARCHAR, '\\.0$', '')"
_INNER = f"""CASE WHEN json_type(json_extract(v, '$."' || i || '"')) IN {_KINDS} THEN {_PLAIN.format(x="json_extract(v, '$.\"' || i || '\"')")}
      ELSE json_extract(v, '$."' || i || '"')::VARCHAR END"""
_VALUE = f"""CASE WHEN json_type(v) IN {_KINDS} THEN {_PLAIN.format(x="v")}
    WHEN json_type(v) = 'OBJECT' THEN '{{{{' || array_to_string(list_sort(list_transform(json_keys(v), lambda i: '"' || i || '":' || {_INNER})), ',') || '}}}}' ELSE v ->> '$' END"""
_ATTRS = f""", array_to_string(list_sort(list_transform(list_transform(list_distinct(json_keys(m)), lambda k: {{{{'k': k, 'v': json_extract(m, '$."' || k || '"')}}}}),
  lambda e: e.k || '=' || coalesce(list_transform([e.v], lambda v: {_VALUE})[1], 'null'))), '|') AS attrs""".replace("{{", "{").replace("}}", "}")

SQL = {
    "p1_found": _STATES.replace("{attrs}", ""),
    "p1_history": _STATES.replace("{attrs}", _ATTRS),
    "p5_found": f"SELECT coll_name, id, entry_no FROM ({_LIVE})",
    "p5_state": f"""
WITH live AS ({_LIVE}),
gone AS (SELECT coll_name, id, max((ts, entry_no)) AS at FROM wal_entries WHERE op = 1 AND id IS NOT NULL GROUP BY ALL),
told AS (
  SELECT coll_name, id, metadata, row_number() OVER (PARTITION BY coll_name, id ORDER BY ts DESC, entry_no DESC) AS rn
  FROM wal_entries w LEFT JOIN gone g USING (coll_name, id)
  WHERE op = 0 AND metadata IS NOT NULL AND (g.at IS NULL OR (w.ts, w.entry_no) > g.at))
SELECT l.coll_name, l.id, l.vec_values, t.metadata
FROM live l LEFT JOIN told t ON t.coll_name = l.coll_name AND t.id = l.id AND t.rn = 1""",
    "p5_on_base": f"""
WITH valid AS (SELECT * FROM wal_entries WHERE op IN (0, 1) AND id IS NOT NULL AND coll_name IS NOT NULL AND ts IS NOT NULL),
last AS (SELECT coll_name, id, arg_max(op, (ts, entry_no)) AS op, arg_max(entry_no, (ts, entry_no)) AS entry_no FROM valid GROUP BY ALL),
gone AS (SELECT coll_name, id, max((ts, entry_no)) AS at FROM valid WHERE op = 1 GROUP BY ALL),
told AS (
  SELECT coll_name, id, arg_max(metadata, (ts, entry_no)) AS metadata FROM valid v LEFT JOIN gone g USING (coll_name, id)
  WHERE op = 0 AND metadata IS NOT NULL AND (g.at IS NULL OR (v.ts, v.entry_no) > g.at) GROUP BY ALL),
base AS (SELECT coll_name, id FROM wal_entries WHERE id IS NOT NULL AND coll_name IS NOT NULL UNION SELECT coll_name, id FROM vectors WHERE id IS NOT NULL AND coll_name IS NOT NULL)
SELECT b.coll_name, b.id, l.entry_no, CASE WHEN g.at IS NULL THEN coalesce(t.metadata, '{{"base":1}}') ELSE t.metadata END AS metadata
FROM base b LEFT JOIN last l USING (coll_name, id) LEFT JOIN gone g USING (coll_name, id) LEFT JOIN told t USING (coll_name, id)
WHERE l.op IS NULL OR l.op = 0""",
}
