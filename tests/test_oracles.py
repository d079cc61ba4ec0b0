"""Every SQL-checked query equals its DuckDB oracle (sf0.001, exact values)."""
import math

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# queries whose oracle hard-codes the fitted schema of the checked scale
SCHEMA_FITTED = {"features", "prepared", "total_nulls", "overview", "anova_f", "k_best",
                 "mutual_info", "null_by_target", "missing_pattern"}


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def v(x):
        if isinstance(x, float) and math.isnan(x):
            return None
        return x
    return sorted((tuple(v(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def _names():
    from __spark_entry__ import oracle_sql
    return [n for n in oracle_sql() if n not in SCHEMA_FITTED]


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF_SMALL)
    res = con.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), dcols)
