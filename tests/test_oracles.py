"""Every query that SQL expresses, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"logistic_baseline", "gbt_baseline", "feature_importance"}


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{float(value):.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - {n for n in entry.oracle_sql() if n.startswith("op") or n == "pipeline"}))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = entry.queries()[name](spark, SF)
    expected = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert table(found.columns, found.collect()) == table(names, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
