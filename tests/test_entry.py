import __spark_entry__ as entry


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "id", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_equal_sql(spark):
    """A sample of the SQL comparisons at the smallest scale."""
    import duckdb

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("embeddings", "documents", "events", "vectors", "coll_config", "wal_entries", "vector_versions"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("knn_dot", "filter_nested", "filter_json_number", "knn_overfetch", "sq8_encode", "filter_builders", "p5_state", "p1_found"):
        got = entry.queries()[name](spark, sf)
        rel = c.sql(entry.oracle_sql()[name])
        cols = sorted(got.columns)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(x) for x in cols]
        assert sorted(repr(tuple(r[x] for x in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()), name


def test_engine_queries_equal_sql(spark):
    """A part of what goes through the store, the collections, the index and the REST adapter."""
    import duckdb

    from sparvex.plans.engine import QUERIES, SQL

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("embeddings", "events"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert set(QUERIES) == set(SQL)
    for name in ("compact_late", "update_version", "catalog_reopen", "catalog_errors", "collection_search", "export_import", "rng_graph", "graph_data", "rest_contract"):
        got, rel = QUERIES[name](spark, sf), c.sql(SQL[name])
        cols = sorted(got.columns)
        assert sorted(rel.columns) == cols, name
        at = [rel.columns.index(x) for x in cols]
        assert sorted(repr(tuple(r[x] for x in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()), name
