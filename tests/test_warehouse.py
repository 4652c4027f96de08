"""Joins, merges, decisions and screens on small and odd tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import decisions as dc
from lodestrand.operators import performance as pf
from lodestrand.operators import portfolio as pt
from lodestrand.operators import warehouse as wh


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 5), (3, 6)], "k int, b int")
    assert [tuple(r) for r in wh.one_to_one(a, b, ["k"]).collect()] == [(1, "x", 5)]
    with pytest.raises(Exception, match="right side has a key twice"):
        wh.one_to_one(a, b.union(b), ["k"]).collect()
    flags = wh.outer_filled(a.select("k", F.lit(1).alias("s")), b.select("k", F.lit(1).alias("t")), ["k"])
    assert sorted(map(tuple, flags.collect())) == [(1, 1, 1), (2, 1, 0), (3, 0, 1)]
    assert wh.one_row(a.filter("k = 9"), b.filter("k = 1")).count() == 1 and wh.one_row(a.filter("k = 9"), b.filter("k = 9")).count() == 0


def test_upsert_and_status(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k int, v double, w string")
    new = spark.createDataFrame([(2, 9.0), (3, 3.0)], "k int, v double")
    assert sorted(map(tuple, wh.upsert(old, new, ["k"]).collect())) == [(1, 1.0, "a"), (2, 9.0, "b"), (3, 3.0, None)]
    batches = spark.createDataFrame([(k, "staged") for k in "abcd"], "batch string, status string")
    results = spark.createDataFrame([("a", 5, None), ("b", 5, "broken"), ("c", 0, None)], "batch string, rows int, error string")
    assert {r["batch"]: r["status"] for r in wh.batch_status(batches, results).collect()} == {"a": "published", "b": "failed", "c": "empty", "d": "staged"}


def test_symbols(spark):
    raw = ["600000.XSHG", "000001.xshe", "SHSE.600001", "SZSE.300001", "600002", "300002", "830001", "430001", "600003.SH"]
    want = ["600000.SH", "000001.SZ", "600001.SH", "300001.SZ", "600002.SH", "300002.SZ", "830001.BJ", "430001.BJ", "600003.SH"]
    df = spark.createDataFrame([(x,) for x in raw], "symbol string")
    assert [r[0] for r in df.select(wh.canonical(F.col("symbol"))).collect()] == want
    members = spark.createDataFrame([("600000.SH",), ("300001.SZ",)], "symbol string")
    assert {r[0] for r in wh.in_universe(df, members).collect()} == {"600000.XSHG", "SZSE.300001"} and wh.in_universe(df, None).count() == 9


def test_readiness(spark):
    frames = {"a": spark.createDataFrame([(day(9), 1)], "d date, x int"), "b": spark.createDataFrame([(day(2), 1)], "d date, x int"), "c": spark.createDataFrame([], "d date, x int")}
    specs = [wh.Dataset("a", ("d",), "d", "data_version"), wh.Dataset("b", ("d",), "d", "max_age_days", 5, required=False), wh.Dataset("c", ("x",), "d"), wh.Dataset("e", ("x",))]
    told = {r["dataset"]: r["errors"] for r in wh.readiness(frames, specs, "a").collect()}
    assert told == {"a": "", "b": "too old", "c": "no rows", "e": "missing dataset"}
    assert tuple(wh.ready(wh.readiness(frames, specs, "a")).first()) == ("blocked", "c,e")
    assert tuple(wh.ready(wh.readiness(frames, specs[:2], "a")).first()) == ("ready", "")
    assert {r["errors"] for r in wh.readiness(frames, specs[:2], "zzz").collect()} == {"no data version"}


def test_gates_skip_what_is_missing(spark):
    schema = "factor string, days long, ic_mean double, icir double, t double, p double, coverage double, turnover double, monotonicity double, drawdown double, kept double, decay double, neutral double, survives boolean, segments int"
    rows = [("good", 200, 0.05, 0.5, 3.0, 0.01, 0.9, 0.3, 0.9, -0.1, 0.9, -0.1, 0.8, True, 3), ("bare", 10, 0.03, 0.1, None, 1.0, 0.2, None, None, None, None, None, None, None, None)]
    e = spark.createDataFrame(rows, schema)
    gates = {r["factor"]: (r["applicable"], r["passed_gates"], r["passed"]) for r in dc.validation_gates(e).collect()}
    assert gates == {"good": (7, 7, True), "bare": (2, 1, True)}
    assert {r["factor"]: r["severity"] for r in dc.red_flags(e).collect()} == {"good": "ok", "bare": "reject"}
    assert {r["factor"]: r["status"] for r in dc.evaluation_status(e).collect()} == {"good": "pass", "bare": "warn"}
    with pytest.raises(ValueError):
        dc.meets(F.lit(1), "about 3")


def test_drawdowns_and_metrics_by_hand(spark):
    navs = [1.0, 1.2, 0.9, 1.0, 1.3, 1.25, 1.1]
    df = spark.createDataFrame([("s", day(k), v, 1.0 + 0.01 * k) for k, v in enumerate(navs)], "strategy string, date date, nav double, benchmark double")
    falls = [tuple(r)[1:] for r in pf.drawdown_events(df).orderBy("start").collect()]
    assert falls == [(day(1), day(2), day(4), -0.25, 2), (day(4), day(6), None, pytest.approx(1.1 / 1.3 - 1, abs=1e-5), 2)]
    assert pf.underwater(df).first()["longest"] == 3
    m = pf.metrics(df).first()
    r = [b / a - 1 for a, b in zip(navs, navs[1:])]
    mean = sum(r) / 6
    sd = (sum((x - mean) ** 2 for x in r) / 6) ** 0.5
    assert m["max_drawdown"] == 0.25 and m["sharpe"] == pytest.approx(mean / sd * 252**0.5, abs=1e-4) and m["sortino"] == pytest.approx(mean * 252**0.5 / (sum(min(x, 0) ** 2 for x in r) / 6) ** 0.5, abs=1e-4)
    assert m["var_95"] == pytest.approx(mean - 1.645 * sd, abs=1e-5) and m["win_rate"] == 0.5
    one = pf.metrics(df.limit(1)).first()
    assert one["observations"] == 1 and one["sharpe"] is None and pf.metrics(df.filter("false")).count() == 0


def test_horizon_exits_by_the_calendar(spark):
    closes = [(day(k), c, float(p)) for c, ps in {"a": [10, 11, 12], "b": [10, None, 20], "c": [10, 10, None]}.items() for k, p in enumerate(ps) if p]
    scores = spark.createDataFrame([(day(0), "a", 3.0), (day(0), "b", 2.0), (day(0), "c", 1.0)], "date date, code string, score double")
    got = pt.horizon_backtest(scores, spark.createDataFrame(closes, "date date, code string, close double"), 1, size=2, least=3, cost=0.0).collect()
    assert len(got) == 1 and got[0]["long_only"] == pytest.approx(0.1) and got[0]["long_short"] == pytest.approx(0.1)
