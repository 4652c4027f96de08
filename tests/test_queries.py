"""Every query with SQL gives the same rows in both engines, a part of them here for time."""

import pytest

from lodestrand.plans import catalog

SAMPLE = ["ic_summary", "quantile_returns", "basket_turnover", "truth_compare", "validation_gates", "performance_window", "drawdown_events", "target_weights", "topk_backtest", "position_ledger", "publish_factor", "readiness_manifest", "traffic_daily", "doc_evaluation", "cs_rank", "sma_gtja", "gtja191", "alpha84"]


def rows(df):
    def show(v):
        if v is None or v != v:
            return ""
        return f"{v:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10]

    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_same_in_both_engines(spark, duck, data, name):
    got = catalog.queries()[name](spark, data).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) > 150


def test_ledgers_run(spark, data):
    for name in ("sleeve_ledger", "target_execution", "etf_rotation"):
        assert catalog.queries()[name](spark, data).count() > 0
