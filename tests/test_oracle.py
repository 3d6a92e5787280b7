"""Every registered query with oracle SQL equals DuckDB on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from riskscope.session import TABLES

from conftest import SF_SMALL

ORACLE = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[name])
    d_cols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(d_cols)
    assert _rows(sdf.columns, s_rows) == _rows(d_cols, res.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "risk_label" in df.columns


def test_every_query_registered_has_oracle_or_is_documented():
    missing = set(E.QUERIES) - set(ORACLE)
    assert missing <= {"cv_leaderboard", "holdout_model_metrics", "feature_importance", "calibrated_scores"}, missing
