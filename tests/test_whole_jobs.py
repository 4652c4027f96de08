"""Queries do their whole job: against brute force that shares no SQL with them."""

import bisect
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import evaluation as ev
from lodestrand.operators import warehouse as wh
from lodestrand.operators.inference import two_sided_p
from lodestrand.plans import catalog
from lodestrand.streaming import bars


def both(spark, duck, data, name):
    got = catalog.queries()[name](spark, data).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()[list(got.columns)]
    return got, want


def test_asof_join_gives_every_order_its_latest_date(spark, duck, data):
    orders = duck.sql("SELECT o_orderkey, CAST(o_orderdate AS DATE) FROM orders").fetchall()
    dates = [r[0] for r in duck.sql("SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS d FROM lineitem ORDER BY d").fetchall()]
    want = {(k, dates[i - 1] if (i := bisect.bisect_right(dates, d)) else None) for k, d in orders}
    assert len(orders) == 1500
    assert {tuple(r) for r in catalog.queries()["asof_join"](spark, data).collect()} == want
    assert set(duck.sql(catalog.oracle_sql()["asof_join"]).fetchall()) == want


def test_asof_join_looks_back_any_time(spark):
    orders = spark.createDataFrame([(1, datetime(2020, 1, 1)), (2, datetime(2020, 1, 6, 23)), (3, datetime(2021, 6, 1)), (4, None)], "o_orderkey long, o_orderdate timestamp")
    panel = spark.createDataFrame([(date(2020, 1, 6),), (date(2020, 1, 6),), (date(2020, 1, 13),)], "date date")
    got = {(r["o_orderkey"], r["snap"]) for r in wh.as_of(orders, "o_orderdate", panel).collect()}
    assert got == {(1, None), (2, date(2020, 1, 6)), (3, date(2020, 1, 13)), (4, None)}


def test_p_is_the_normal_tail(spark):
    rows = spark.range(-288, 289).select((F.col("id") / 8).alias("t")).select("t", ev.two_sided(F.col("t")).alias("p")).collect()
    assert len(rows) == 577
    for t, p in rows:
        assert p == pytest.approx(two_sided_p(t), rel=1e-10)
    assert spark.range(1).select(ev.two_sided(F.lit(None).cast("double"))).first()[0] == 1.0


def test_fdr_corrects_p_values_of_t(spark):
    ts = {"a": 4.0, "b": -2.5, "c": 1.0, "d": None, "e": 2.2}
    tests = spark.createDataFrame(list(ts.items()), "factor string, t double").withColumn("p", ev.two_sided(F.col("t")))
    got = {r["factor"]: r for r in ev.corrected(tests).collect()}
    p = {f: 1.0 if t is None else two_sided_p(t) for f, t in ts.items()}
    order = sorted(p.values())
    for f, own in p.items():
        q = min(min(1, x * len(p) / (k + 1)) for k, x in enumerate(order) if x >= own)
        assert (got[f]["p_value"], got[f]["q_value"], got[f]["bonferroni"]) == pytest.approx((own, q, min(1, own * len(p))), abs=1e-6)
        assert got[f]["significant"] == (q < 0.05)
    assert got["a"]["significant"] and got["b"]["significant"] and not got["c"]["significant"]


@pytest.mark.parametrize("name", ["fdr_bh", "ic_tstat"])
def test_p_values_on_the_tables(spark, duck, data, name):
    import numpy as np

    ic = duck.sql(catalog.oracle_sql()["ic_daily"]).df()
    ic = ic[ic.n >= 5].groupby("factor").ic
    p = (ic.mean() / (ic.std() / np.sqrt(ic.count()))).map(two_sided_p)
    for rows in both(spark, duck, data, name):
        assert len(rows) == 4
        assert rows.set_index("factor").p_value.to_dict() == pytest.approx(p.to_dict(), abs=1e-7)


@pytest.mark.parametrize("name, step", [("ic_decay", "horizon"), ("ic_decay_later", "lag")])
def test_decay_of_rank_ic_over_all_horizons(spark, duck, data, name, step):
    import numpy as np
    import pandas as pd

    panel = duck.sql(catalog.oracle_sql()["panel_load"]).df().sort_values(["code", "date"])
    by = panel.groupby("code")
    values = pd.DataFrame({
        "mom": panel.close / by.close.shift(4) - 1, "rev": -(panel.close / by.close.shift(1) - 1),
        "liq": panel.volume / by.volume.transform(lambda v: v.rolling(4).mean()) - 1, "rng": ((panel.high - panel.low) / panel.close).groupby(panel.code).transform(lambda v: v.rolling(4).mean()),
    }).round(6)
    one = (by.close.shift(-1) / panel.close - 1).round(6)
    ahead = {h: (by.close.shift(-h) / panel.close - 1).round(6) for h in (1, 3, 5, 10, 20)}
    later = {h: one.groupby(panel.code).shift(-h) for h in (0, 1, 3, 5, 10, 20)}
    want = {}
    for h, ret in (ahead if step == "horizon" else later).items():
        for f in values:
            ics = []
            for _, g in pd.DataFrame({"date": panel.date, "x": values[f], "y": ret}).dropna().groupby("date"):
                a, b = g.x.rank(), g.y.rank()
                if len(g) >= 5 and a.std() > 0 and b.std() > 0:
                    ics.append(np.corrcoef(a, b)[0, 1])
            x = np.array(ics)
            want[f, h] = (len(x), x.mean(), x.mean() / x.std(ddof=1), (x > 0).mean())
    for rows in both(spark, duck, data, name):
        got = {(r.factor, getattr(r, step)): (r.n, r.ic_mean, r.icir, r.positive_ratio) for r in rows.itertuples()}
        assert set(got) == set(want)
        for k, w in want.items():
            assert got[k] == pytest.approx(w, abs=2e-4), k


def test_event_bars_keep_bars_with_ties(spark):
    at = datetime(2024, 1, 1, 10)
    events = [(3, at, "a", 5.0), (1, at, "a", 7.0), (2, at.replace(hour=11), "a", 1.0), (5, at.replace(hour=11), "a", 9.0), (5, at.replace(hour=11), "a", 8.0), (9, at.replace(hour=12), "a", None), (4, at, "b", 2.0), (4, at, "b", 2.0)]
    df = spark.createDataFrame(events, "event_id long, ts timestamp, event_type string, value double")
    want = [("a", 6, 7.0, 9.0, 1.0, 9.0), ("b", 2, 2.0, 2.0, 2.0, 2.0)]
    got = bars.bars(df, order="event_id").select("event_type", "n", "open", "high", "low", "close")
    assert sorted(tuple(r) for r in got.collect()) == want
