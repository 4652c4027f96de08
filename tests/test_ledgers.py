"""Folds and engines against plain loops and by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import ledgers as lg
from lodestrand.operators.folds import sorted_fold

TRADES = "account long, code long, time timestamp, seq long, side string, qty double, price double, fee double"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_folds_cross_batches_and_keep_order(spark):
    rows = spark.range(0, 50_000, 1, 7).select((F.col("id") % 3).alias("k"), (F.lit(50_000) - F.col("id")).alias("t"))

    def fold(key, own):
        ts = [r[1] for r in own]
        yield (*key, len(ts), ts == sorted(ts))

    got = sorted(tuple(r) for r in sorted_fold(rows, ["k"], ["t"], fold, "k long, n long, ok boolean").collect())
    assert got == [(0, 16667, True), (1, 16667, True), (2, 16666, True)]
    assert sorted_fold(rows.filter("k = 9"), ["k"], ["t"], fold, "k long, n long, ok boolean").count() == 0


def test_position_ledger_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(4), at(rng.randrange(9)), k, rng.choice(["BUY", "SELL"]), float(rng.randrange(1, 50)), float(rng.randrange(1, 9)), 5.0) for k in range(400)]
    rows += [(9, 9, at(0), 1, "BUY", None, 3.0, None), (None, 1, at(0), 1, "BUY", 1.0, 2.0, 0.0)]
    want = {}
    for a, c, _, _, side, q, p, fee in sorted(rows, key=lambda r: (r[2], r[3])):
        h, cost, real = want.get((a, c), (0.0, 0.0, 0.0))
        q, fee = q or 0.0, fee or 0.0
        if side == "BUY":
            cost, h = ((cost * h + q * p + fee) / (h + q) if h + q else 0.0), h + q
        else:
            sold = min(q, h)
            real, h = real + sold * (p - cost) - fee, h - sold
        want[a, c] = (h, cost, real)
    df = spark.createDataFrame(rows, TRADES)
    got = {(r[0], r[1]): tuple(r)[2:] for r in lg.position_ledger(df).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w)
    assert lg.position_ledger(df.filter("code = 77")).count() == 0


def test_account_equity(spark):
    df = spark.createDataFrame([(1, 7, at(0), 1, "BUY", 100.0, 10.0, 5.0), (1, 7, at(1), 2, "SELL", 40.0, 12.0, 5.0)], TRADES)
    last = spark.createDataFrame([(7, 11.0)], "code long, price double")
    r = lg.account_equity(lg.position_ledger(df), df, last).first()
    assert r["equity"] == 10_130.0


def test_sleeves_share_cash(spark):
    days = [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 2)]
    navs = {"a": [1.0, 2.0, 2.0, 1.0], "b": [1.0, 1.0, 1.0, 1.0]}
    rows = [("p", s, 0.5, d, v, 1.0) for s, own in navs.items() for d, v in zip(days, own)] + [("p", "a", 0.5, dt.date(2024, 2, 5), 9.0, 1.0)]
    got = lg.sleeve_ledger(spark.createDataFrame(rows, "portfolio string, sleeve string, weight double, date date, nav double, benchmark double"), cash=100.0, cost=0.01).orderBy("date").collect()
    assert [r["date"] for r in got] == days  # a date that only one sleeve has doesn't count
    first = 50.0 + min(50.0, (100.0 - 50.0 * 1.01) / 1.01)
    assert got[0]["traded"] == pytest.approx(first) and got[0]["nav"] * 100 == pytest.approx(100 - first * 0.01)
    worth = got[1]["nav"] * 100
    assert worth == pytest.approx(got[0]["nav"] * 100 + 50.0)  # a doubles
    sold = 100.0 - worth / 2
    bought = min(worth / 2 - (first - 50.0), (got[1]["cash"] + sold * 0.99) / 1.01)
    assert got[2]["traded"] == pytest.approx(sold + bought) and got[2]["paid"] == pytest.approx(0.01 * (sold + bought))
    assert got[3]["drawdown"] < -0.1 and got[3]["traded"] == 0


def test_lots(spark):
    cases = [("688001", 199.9, 0), ("688001", 250.7, 250), ("688001", 1e6, 100_000), ("430001", 150, 150), ("830001", 99, 0), ("300001", 399_999, 300_000), ("301001", 250, 200), ("600001", 99, 0), ("600001", 1_234_567, 1_000_000), ("000001", -5, 0)]
    df = spark.createDataFrame([(c, float(x)) for c, x, _ in cases], "c string, x double")
    assert [lg.lot(c, x) for c, x, _ in cases] == [w for _, _, w in cases]
    assert [r[0] for r in df.select(lg.lots(F.col("c"), F.col("x"))).collect()] == [w for _, _, w in cases]


def test_target_execution_by_hand(spark):
    days = [dt.date(2024, 1, k) for k in (2, 3, 4)]
    bars = [(d, c, p) for d, ps in zip(days, ([10.0, 20.0], [11.0, 20.0], [12.0, 10.0])) for c, p in zip(("600001", "600002"), ps)] + [(days[0], "600009", 5.0)]
    signals = [("s", days[0], "600001", 0.5), ("s", days[0], "600002", 0.4), ("s", days[2], "600002", 0.5)]
    got = lg.execute_targets(spark.createDataFrame(bars, "date date, code string, close double"), spark.createDataFrame(signals, "strategy string, date date, code string, weight double"), cash=100_000.0).collect()
    trades = [(r["date"], r["code"], r["side"], r["qty"], r["amount"], r["fee"]) for r in got if r["kind"] == "trade"]
    n1, n2 = int(100_000 * 0.5 / 10.01) // 100 * 100, int(100_000 * 0.4 / 20.02) // 100 * 100
    value = 100_000 - n1 * 10 - 15.0 + n1 * 12 - n2 * 20 - round(n2 * 20 * 0.0003, 2) + n2 * 10
    fee1 = round(max(round(n1 * 10 * 0.0003, 2), 5), 2)
    assert trades[0] == (days[0], "600001", "buy", n1, n1 * 10.0, fee1)
    assert trades[1][:4] == (days[0], "600002", "buy", n2)
    assert trades[2][:4] == (days[2], "600001", "sell", n1) and trades[2][5] == round(max(round(n1 * 12 * 0.0003, 2), 5) + round(n1 * 12 * 0.001, 2), 2)
    assert trades[3][1] == "600002" and trades[3][2] == "buy"
    navs = [r["value"] for r in got if r["kind"] == "nav"]
    assert len(navs) == 3 and navs[1] == pytest.approx(navs[0] + n1)
    assert navs[2] < value  # costs of the last day


def test_purchases_beyond_the_cash_are_left_out(spark):
    day = dt.date(2024, 1, 2)
    bars = spark.createDataFrame([(day, "600001", 10.0), (day, "600002", 11.0)], "date date, code string, close double")
    signals = spark.createDataFrame([("s", day, "600001", 0.7), ("s", day, "600002", 0.7)], "strategy string, date date, code string, weight double")
    got = [r["code"] for r in lg.execute_targets(bars, signals, cash=100_000.0).collect() if r["kind"] == "trade"]
    assert got == ["600001"]
    assert lg.execute_targets(bars, signals.filter("weight > 1")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_filled_weights_keep_all_limits(seed):
    rng = random.Random(seed)
    ranked = [(f"c{k}", f"s{rng.randrange(4)}") for k in range(rng.randrange(0, 15))]
    budget = rng.choice([0.0, 0.2, 0.5, 1.0])
    w = lg.filled_weights(ranked, budget)
    sectors = {}
    for c, x in w.items():
        assert x <= 0.2 + 1e-9
        sectors[dict(ranked)[c]] = sectors.get(dict(ranked)[c], 0.0) + x
    assert sum(w.values()) <= budget + 1e-9 and all(x <= 0.3 + 1e-9 for x in sectors.values())
    if budget == 1.0 and len(sectors) == 4 and all(sum(dict(ranked)[c] == s for c in w) >= 2 for s in sectors):
        assert sum(w.values()) == pytest.approx(1.0, abs=1e-6)


def test_rotation_cuts_risk(spark):
    days = [dt.date(2024, 1, k) for k in range(2, 8)]
    rows = [(d, "BULL" if k < 4 else "CRASH", c, s, 1.0 - 0.1 * j, -0.2) for k, d in enumerate(days) for j, (c, s) in enumerate([("a", "x"), ("b", "y"), ("c", "z")])]
    df = spark.createDataFrame(rows, "date date, regime string, code string, sector string, score double, ret double")
    got = lg.rotate(df, {"r": lg.Rotation(defensive=("z",), cost=0.0)}).orderBy("date").collect()
    assert got[0]["turnover"] == pytest.approx(0.6) and got[0]["equity"] == pytest.approx(0.88)
    assert got[1]["names"] == 0 and got[2]["equity"] == got[1]["equity"]  # beyond the stop nothing is held
    best = lg.tuned(df, {"stop": [0.05, 0.5], "alert": [0.02, 0.4]}, lg.Rotation(alert2=0.45, cost=0.0)).orderBy("place").collect()
    assert len(best) == 4 and [r["place"] for r in best] == [1, 2, 3, 4] and best[0]["max_drawdown"] <= best[-1]["max_drawdown"]


def test_breakouts_on_both_sides(spark):
    wr = [50, 50, 50, 40, 46, 46, 46, 46, -50, -40, -46, -46, -46, -46]
    rsi = [70] * 8 + [20] * 6
    close = [100, 100, 100, 100, 100, 103, 103, 101, 100, 100, 100, 99, 98, 99.2]
    rows = [("x", dt.date(2024, 1, k + 1), c + 1.0, c - 1.0, float(c), float(r), float(w)) for k, (c, r, w) in enumerate(zip(close, rsi, wr))]
    got = [(r["date"].day, r["action"], r["reason"]) for r in lg.breakout_machine(spark.createDataFrame(rows, "code string, date date, high double, low double, close double, rsi double, wr double"), cooldown=3, trail=0.02).orderBy("date").collect()]
    assert got == [(5, "BUY", "breakout"), (8, "CLOSE_LONG", "trail"), (11, "SELL", "breakout"), (14, "CLOSE_SHORT", "trail")]
