"""Plan-shape checks: the flagship is map-only after the scan and parses
each URL once."""

from riskscope.plans.catalog import QUERIES
from riskscope.session import read_table
from riskscope.plans import score_pages as SP

from conftest import SF_SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_no_shuffle_besides_spread(spark):
    pages = read_table(spark, SF_SMALL, "pages", spread_rows=False)
    p = plan_text(SP.flagship_report(pages))
    assert "Exchange" not in p and "BroadcastHashJoin" not in p and "SortMergeJoin" not in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p


def test_url_parsed_once(spark):
    pages = read_table(spark, SF_SMALL, "pages", spread_rows=False)
    opt = QUERIES["url_features"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # five RFC 3986 groups are extracted once each, not once per feature
    assert opt.count("regexp_extract") <= 16, opt.count("regexp_extract")
    del pages


def test_scan_prunes_columns(spark):
    p = plan_text(QUERIES["url_features"](spark, SF_SMALL))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p
