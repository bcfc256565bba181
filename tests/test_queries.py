"""Every query of the core against its SQL on the smallest tables, and the shapes of plans."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from recollex.plans import registry


def plain(value):
    if isinstance(value, float):
        assert not math.isnan(value)
        return round(value, 6)
    return value


def rows_of(rows, columns, order):
    return sorted(str([plain(row[columns.index(c)]) for c in order]) for row in rows)


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for file in os.listdir(data):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    found = registry.queries()[name](spark, data)
    rows = found.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert found.columns
        return
    wanted = duck.sql(sql)
    assert sorted(found.columns) == sorted(wanted.columns)
    order = sorted(found.columns)
    assert rows_of(rows, found.columns, order) == rows_of(wanted.fetchall(), wanted.columns, order)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    from recollex.operators import entries as en
    from recollex.sources.tables import table

    rows = table(spark, data, "memory_entries")
    text = plan(rows.where(en.Filters(kind="fact", workspace="x").condition()).select("id"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "EqualTo(kind,fact)" in scan and "EqualTo(workspace,x)" in scan and "content" not in scan.split("ReadSchema")[1]
    listed = plan(en.list_recent(en.current(rows), 5).select("id"))
    assert "TakeOrderedAndProject" in listed and "WindowGroupLimit" in listed and "content" not in listed.split("ReadSchema")[-1]


@pytest.mark.parametrize("name", ["supersede_pairs", "jaccard_pairs", "keyword_search", "hybrid_search", "causal_validate", "vector_missing", "dedup_merge"])
def test_no_product_of_tables(spark, data, name):
    text = plan(registry.queries()[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_searches_end_in_a_top_k(spark, data):
    from recollex.operators import search
    from recollex.plans.searches import visible

    assert "TakeOrderedAndProject" in plan(search.keyword_search(visible(spark, data), "root cause", "2026-01-15 00:00:00"))
