"""Every registered query of the library against its SQL in DuckDB, and those without one for their rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomwork.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([plain(y) for y in x])
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, np.integer)):
        return str(int(x))
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 5) + 0.0)
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = sorted([plain(v) for v in r] for r in map(tuple, df.select(*sorted(df.columns)).collect()))
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert rows == sorted([plain(r[i]) for i in at] for r in found.fetchall())


def same_as_sql(spark, folder, name, **tables):
    """The query and its SQL on tables that are given as DuckDB's."""
    c = duckdb.connect()
    for table, sql in tables.items():
        c.execute(f"copy ({sql}) to '{folder}/{table}.parquet'")
        c.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    rows = sorted([plain(v) for v in r] for r in map(tuple, df.select(*columns).collect()))
    found = c.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert rows and rows == sorted([plain(v) for v in r] for r in found)


def test_a_value_that_stands_for_a_missing_one(spark, tmp_path):
    values = "(values (1, 1, 42.0), (2, 1, 5.0), (3, 1, 6.0), (4, 2, 41.0), (5, 2, 7.0), (6, 2, 8.0)) t(event_id, user_id, value)"
    same_as_sql(spark, tmp_path, "valid_event_groups", events=f"select event_id, user_id, value::DOUBLE as value from {values}")


def test_display_of_large_and_missing_numbers(spark, tmp_path):
    values = "(values (999, 5), (1000, 59), (999999, 60), (1000000, 61), (1234567, null), (null, 7)) t(p_partkey, p_size)"
    same_as_sql(spark, tmp_path, "display_formats", part=f"select p_partkey::BIGINT as p_partkey, p_size::INT as p_size from {values}")


_COPIES = "select i::BIGINT as vec_id, list_transform(range(1, 65), lambda j: CASE WHEN i % 40 = 9 THEN 0 ELSE sin(j * (1 + i % 40) * 1.7) END::FLOAT) as embedding, (i * 7 // 5 % 6)::INT as label from range(170) t(i)"


@pytest.mark.parametrize("name", ["difficulty_neighbors", "item_item", "retrieval_metrics", "disagreement_mining", "set_retrieval"])
def test_whole_rankings_without_listed_pairs(spark, tmp_path, monkeypatch, name):
    from loomwork.operators import vectors

    monkeypatch.setattr(vectors, "nearest", None)  # it gave a row a pair
    monkeypatch.setattr(vectors, "TASK_QUERIES", 50)
    monkeypatch.setattr(vectors, "HELD_SCORES", 1 << 13)
    same_as_sql(spark, tmp_path, name, embeddings=_COPIES)
