"""Every query with SQL agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from candlewick.plans.registry import QUERIES, SQL
from oracle import connect, difference


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, small, con, name):
    assert difference(QUERIES[name](spark, small), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_pushdown_and_group_limit(spark, small):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scan = plan(QUERIES["filter_scan"](spark, small))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,50.0)]" in scan and "ReadSchema: struct<event_id:bigint,value:double>" in scan
    assert "WindowGroupLimit" in plan(QUERIES["top1_per_group"](spark, small))
    assert "TakeOrderedAndProject" in plan(QUERIES["top_k"](spark, small))


def test_stream_ohlcv_shows_closed_bars_that_the_stream_lost(spark, small, monkeypatch):
    from candlewick.streaming import indicators

    bars = indicators.stream_ohlcv
    run = __spark_entry__.queries()["stream_ohlcv"]
    n = __spark_entry__.queries()["ohlcv"](spark, small).where("symbol = 'click'").count()
    assert run(spark, small).where("symbol = 'click'").count() == n
    monkeypatch.setattr(indicators, "stream_ohlcv", lambda *a: bars(*a).where("symbol <> 'click'"))
    assert run(spark, small).where("symbol = 'click'").count() <= 1 < n
