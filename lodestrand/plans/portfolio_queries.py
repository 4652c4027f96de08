"""Queries of scores, portfolios, backtests and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.operators import evaluation as ev
from lodestrand.operators import ledgers as lg
from lodestrand.operators import portfolio as pt
from lodestrand.plans.evaluation_queries import factors, mom
from lodestrand.plans.layers import compute, rounded
from lodestrand.plans.oracles.frames import place, query, r
from lodestrand.plans.oracles.operators import last
from lodestrand.plans.registry import Registry
from lodestrand.sources.panel import brand_week, table

QUERIES = Registry()
USED = ("mom", "rev", "liq")


def scores(s, d) -> DataFrame:
    return pt.mean_rank_score(factors(s, d), USED)


def _share(f: str) -> str:
    return f"CASE WHEN {f} IS NOT NULL THEN {place(f, 'date')} / count({f}) OVER (PARTITION BY date) END"


_SCORES = {
    "shares": "SELECT date, code, " + ", ".join(f"{_share(f)} AS {f}" for f in USED) + " FROM factor",
    "scores": f"SELECT date, code, {r('((coalesce(mom, 0) + coalesce(rev, 0) + coalesce(liq, 0)) / nullif((mom IS NOT NULL)::INT + (rev IS NOT NULL)::INT + (liq IS NOT NULL)::INT, 0))', 8)} AS score FROM shares",
    "placed": "SELECT date, code, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS top, row_number() OVER (PARTITION BY date ORDER BY score, code DESC) AS bottom, count(*) OVER (PARTITION BY date) AS n FROM scores WHERE score IS NOT NULL",
}


@QUERIES.add(query(f"SELECT date, code, {r('score')} AS score FROM scores", "factor", **_SCORES))
def alpha_score(s, d):
    return scores(s, d).withColumn("score", rounded(F.col("score"), 6))


@QUERIES.add(query(f"SELECT date, code, {r('(0.2 * mom + 0.2 * rev + 0.4 * liq)')} AS score FROM (SELECT date, code, " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN {place(f, 'date')} END AS {f}" for f in USED) + " FROM factor)", "factor"))
def multi_factor_score(s, d):
    return pt.rank_sum_score(factors(s, d), {"mom": 0.2, "rev": 0.2, "liq": 0.4})


@QUERIES.add(query(f"SELECT date, code, {r('least(1.0 / least(n, 8), 0.1)')} AS weight FROM placed WHERE top <= 8", "factor", **_SCORES))
def target_weights(s, d):
    return pt.target_weights(scores(s, d), 8)


@QUERIES.add(query(f"SELECT date, code, CASE WHEN top <= least(5, n // 2) THEN 'long' ELSE 'short' END AS side, {r('(CASE WHEN top <= least(5, n // 2) THEN 1 ELSE -1 END * least(0.5 / least(5, n // 2), 0.1))')} AS weight FROM placed WHERE n >= 2 AND (top <= least(5, n // 2) OR bottom <= least(5, n // 2))", "factor", **_SCORES))
def long_short_targets(s, d):
    return pt.long_short_targets(scores(s, d), 5)


@QUERIES.add(query(
    " UNION ALL ".join(f"SELECT '{k}' AS kind, date FROM panel GROUP BY date HAVING date = (SELECT max(o.date) FROM panel o WHERE date_trunc('{u}', o.date) = date_trunc('{u}', panel.date))" for k, u in (("weekly", "week"), ("monthly", "month"), ("quarterly", "quarter")))
    + " UNION ALL SELECT 'daily', date FROM panel GROUP BY date UNION ALL SELECT 'single', max(date) FROM panel UNION ALL SELECT 'as_of', max(date) FROM panel WHERE date <= DATE '1998-02-11'", "panel"))
def rebalance_dates(s, d):
    dates = brand_week(s, d).select("date")
    kinds = ["weekly", "monthly", "quarterly", "daily", "single", "as_of"]
    every = [pt.rebalance_dates(dates, k, "1998-02-11").select(F.lit(k).alias("kind"), "date") for k in kinds]
    out = every[0]
    for one in every[1:]:
        out = out.unionByName(one)
    return out


_EXITS = {
    **_SCORES,
    "numbered": "SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM panel)",
    "entered": "SELECT s.*, x.close / p.close - 1 AS r, greatest(1, n // 10) AS leg FROM placed s JOIN panel p USING (date, code) JOIN numbered a USING (date) JOIN numbered b ON b.day = a.day + 5 LEFT JOIN panel x ON x.date = b.date AND x.code = s.code WHERE n >= 20",
}


@QUERIES.add(query(f"SELECT date, max(n) AS n, {r('(avg(r) FILTER (top <= leg) - 0.0015)')} AS long_only, {r('(avg(r) FILTER (top <= leg) - avg(r) FILTER (bottom <= leg) - 0.003)')} AS long_short FROM entered GROUP BY date", "factor", "panel", **_EXITS))
def topk_backtest(s, d):
    """Held for five weeks of the market's calendar; 20 codes of the 25 make a section."""
    return pt.horizon_backtest(scores(s, d), brand_week(s, d), 5, 0.1, least=20)


_LEGS = {
    "shared": f"SELECT date, code, fwd, {place('value', 'date')} / count(*) OVER (PARTITION BY date) AS pr, count(*) OVER (PARTITION BY date) AS n FROM pairs WHERE factor = 'mom'",
    "sided": "SELECT date, code, fwd, n, CASE WHEN pr >= 0.8 THEN 1 WHEN pr <= 0.2 THEN -1 END AS side FROM shared WHERE n >= 5",
    "days_of": "SELECT date, avg(fwd) FILTER (side = 1) - avg(fwd) FILTER (side = -1) AS r, count(*) AS n, row_number() OVER (ORDER BY date) AS day FROM sided GROUP BY date HAVING count(*) FILTER (side = 1) > 0 AND count(*) FILTER (side = -1) > 0",
    "held": "SELECT s.code, s.side, d.day FROM sided s JOIN days_of d USING (date) WHERE side IS NOT NULL",
    "legs_of": "SELECT side, day, count(*) AS k FROM held GROUP BY ALL",
    "met": "SELECT a.side, a.day, count(*) AS both FROM held a JOIN held b ON a.code = b.code AND a.side = b.side AND b.day = a.day - 1 GROUP BY ALL",
    "moved": "SELECT a.day, avg(1 - coalesce(m.both, 0) / (a.k + b.k - coalesce(m.both, 0))) AS turnover FROM legs_of a JOIN legs_of b ON a.side = b.side AND b.day = a.day - 1 LEFT JOIN met m ON m.side = a.side AND m.day = a.day GROUP BY a.day",
    "walk": "SELECT *, sum(ln(greatest(1 + r, 1e-9))) OVER (ORDER BY day) AS l FROM days_of",
    "curve": f"SELECT date, {r('r')} AS r, {r('l')} AS log_nav, {r('(exp(l - greatest(0, max(l) OVER (ORDER BY day))) - 1)')} AS drawdown, {r('turnover')} AS turnover, n FROM walk LEFT JOIN moved USING (day)",
}


@QUERIES.add(query("SELECT * FROM curve", "pairs", **_LEGS))
def long_short_backtest(s, d):
    return pt.long_short_backtest(mom(s, d))


_YEAR = "least(252.0, 365.25 / (date_diff('day', min(date), max(date)) / (count(*) - 1)))"


@QUERIES.add(query(f"""SELECT count(*) AS periods, {r(_YEAR, 4)} AS per_year, {r(f'(avg(r) * {_YEAR})', 5)} AS annual, {r(f'(stddev_samp(r) * sqrt({_YEAR}))', 5)} AS volatility, {r(f'(avg(r) / stddev_samp(r) * sqrt({_YEAR}))', 5)} AS sharpe,
  min(drawdown) AS max_drawdown, {r('avg(turnover)')} AS turnover, {r('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate FROM curve""", "pairs", **_LEGS))  # fmt: skip
def strategy_report(s, d):
    return pt.strategy_report(pt.long_short_backtest(mom(s, d)))


_MONTHLY = {
    "months": "SELECT code, date_trunc('month', date) AS m, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close FROM panel GROUP BY ALL",
    "last_factor": "SELECT code, date_trunc('month', date) AS m, arg_max(mom, date) AS value FROM factor WHERE mom IS NOT NULL GROUP BY ALL",
}


@QUERIES.add(query(f"SELECT f.code, CAST(f.m AS DATE) AS month, {r('f.value')} AS value, {r('(b.last_close / a.last_close - 1)')} AS ret FROM last_factor f JOIN months a ON a.code = f.code AND a.m = f.m JOIN months b ON b.code = f.code AND b.m = f.m + INTERVAL 1 MONTH", "factor", "panel", **_MONTHLY))
def monthly_resample(s, d):
    """The last factor of a month with the return over the next month, by month ends."""
    month = F.to_date(F.date_trunc("month", "date"))
    closes = brand_week(s, d).groupBy("code", month.alias("month")).agg(F.max_by("close", "date").alias("close"))
    last_value = factors(s, d).filter("mom IS NOT NULL").groupBy("code", month.alias("month")).agg(F.max_by("mom", "date").alias("value"))
    following = closes.select("code", F.add_months("month", -1).alias("month"), F.col("close").alias("next_close"))
    joined = last_value.join(closes, ["code", "month"]).join(following, ["code", "month"])
    return joined.select("code", "month", rounded(F.col("value"), 6).alias("value"), rounded(F.try_divide("next_close", "close") - 1, 6).alias("ret"))


@QUERIES.add(query(f"SELECT date, code, {r('(1.0 / 10)')} AS weight FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY cap, code) AS k, count(*) OVER (PARTITION BY date) AS n FROM panel WHERE cap > 0 AND month(date) % 3 = 0) WHERE k <= 10 AND n >= 20", "panel"))
def micro_cap_snapshots(s, d):
    """The ten smallest caps of each snapshot itself; 20 codes at least."""
    own = brand_week(s, d).filter("month(date) % 3 = 0")
    return pt.smallest(own, own.select("date"), 10, 20)


@QUERIES.add(query(f"SELECT w.date, k.code, {r('0.1')} AS weight FROM (SELECT DISTINCT date FROM panel) w JOIN (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY cap, code) AS k, count(*) OVER (PARTITION BY date) AS n FROM panel WHERE cap > 0 AND month(date) % 3 = 0) k ON k.date = (SELECT max(date) FROM panel o WHERE month(o.date) % 3 = 0 AND o.date <= w.date) WHERE k <= 10 AND n >= 20", "panel"))
def micro_cap(s, d):
    """The ten smallest caps by the latest quarterly snapshot up to each week."""
    panel = brand_week(s, d)
    return pt.smallest(panel.filter("month(date) % 3 = 0"), panel.select("date"), 10, 20)


_REPORTS = {
    "years": "SELECT c_nationkey AS symbol, CAST(date_trunc('year', o_orderdate) AS DATE) AS date, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS profit, sum(CAST(abs(c_acctbal) AS DECIMAL(18,2)))::DOUBLE AS equity FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "grown": "SELECT *, profit / nullif(equity, 0) AS roe, (profit - lag(profit) OVER w) / nullif(abs(lag(profit) OVER w), 0) AS growth FROM years WINDOW w AS (PARTITION BY symbol ORDER BY date)",
}


def yearly_reports(s, d) -> DataFrame:
    """Stand-in reports: orders of a nation in a year as profit, balances of who ordered as equity."""
    exact = lambda c: F.sum(F.expr(f"CAST({c} AS DECIMAL(18,2))")).cast("double")
    joined = table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    own = joined.groupBy(F.col("c_nationkey").alias("symbol"), F.to_date(F.date_trunc("year", "o_orderdate")).alias("date")).agg(exact("o_totalprice").alias("profit"), exact("abs(c_acctbal)").alias("equity"))
    before = F.lag("profit").over(Window.partitionBy("symbol").orderBy("date"))
    return own.withColumns({"roe": F.try_divide("profit", "equity"), "growth": F.try_divide(F.col("profit") - before, F.abs(before))})


@QUERIES.add(query(f"SELECT symbol, date AS report, {r('roe')} AS roe, {r('growth')} AS growth FROM grown", **_REPORTS))
def fundamental_growth(s, d):
    return yearly_reports(s, d).select("symbol", F.col("date").alias("report"), rounded(F.col("roe"), 6).alias("roe"), rounded(F.col("growth"), 6).alias("growth"))


@QUERIES.add(query(
    f"""SELECT date, symbol, k AS place, {r('(1.0 / least(n, 20))')} AS weight FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY y DESC, symbol) AS k, count(*) OVER (PARTITION BY date) AS n
      FROM (SELECT date, symbol, equity / profit AS y FROM years) WHERE y > 0 AND y <= 0.15 AND symbol IN (SELECT symbol FROM grown WHERE roe > 0.05 AND profit > 0 AND coalesce(growth, 0) <= 0.2 QUALIFY date = max(date) OVER (PARTITION BY symbol))) WHERE n >= 5 AND k <= 20""".replace("SELECT symbol FROM grown WHERE roe > 0.05 AND profit > 0 AND coalesce(growth, 0) <= 0.2 QUALIFY date = max(date) OVER (PARTITION BY symbol)", "SELECT g.symbol FROM grown g JOIN (SELECT symbol, max(date) AS date FROM grown GROUP BY symbol) USING (symbol, date) WHERE g.roe > 0.05 AND g.profit > 0 AND coalesce(g.growth, 0) <= 0.2"), **_REPORTS))  # fmt: skip
def dividend_topn(s, d):
    """Equity over profit stands in for the yield; five symbols make a pool here."""
    reports = yearly_reports(s, d)
    latest = reports.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter("k = 1")
    return pt.dividend_pool(reports.select("date", "symbol", F.try_divide("equity", "profit").alias("yield")), latest, least=5)


@QUERIES.add(query("SELECT date, code, amount FROM (SELECT date, code, amount, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS k FROM panel WHERE amount >= 20000 OR code IN ('Brand#11', 'Brand#22')) WHERE k <= 10", "panel"))
def liquid_pool(s, d):
    panel = brand_week(s, d)
    return pt.liquid_pool(panel.unionByName(panel.filter("code = 'Brand#11'")), 20_000, ["Brand#11", "Brand#22"], 10)


@QUERIES.add(query("SELECT date, code FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS k FROM (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY amount DESC, code) AS own FROM panel) WHERE own <= 3) WHERE k <= 8", "panel"))
def sector_capped_pool(s, d):
    return pt.sector_capped(brand_week(s, d), 3, 8)


_TABLE = {"mom20": "RET(close, 20)", "mom60": "RET(close, 60)", "vol20": "STD1(returns, 20)", "rsi14": "100 - 100 / (1 + MEAN(GREATEST(DELTA(close, 1), 0), 14) / MEAN(GREATEST(-1 * DELTA(close, 1), 0), 14))", "trend50": "close / MEAN(close, 50) - 1", "dd60": "close / TSMAX(close, 60) - 1", "ma20_gap": "close / MEAN(close, 20) - 1"}
_TABLE_SQL = {
    "moved": "SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret, close - lag(close) OVER (PARTITION BY code ORDER BY date) AS step FROM panel",
    "told": f"""SELECT date, code, {r('(close / lag(close, 20) OVER (PARTITION BY code ORDER BY date) - 1)')} AS mom20, {r('(close / lag(close, 60) OVER (PARTITION BY code ORDER BY date) - 1)')} AS mom60,
      {r(f'(CASE WHEN count(ret) OVER {last(20)} = 20 THEN stddev_samp(ret) OVER {last(20)} END)')} AS vol20, {r(f'(CASE WHEN count(step) OVER {last(14)} = 14 THEN 100 - 100 / (1 + avg(greatest(step, 0)) OVER {last(14)} / nullif(avg(greatest(-step, 0)) OVER {last(14)}, 0)) END)')} AS rsi14,
      {r(f'(CASE WHEN count(close) OVER {last(50)} = 50 THEN close / avg(close) OVER {last(50)} - 1 END)')} AS trend50, {r(f'(CASE WHEN count(close) OVER {last(60)} = 60 THEN close / max(close) OVER {last(60)} - 1 END)')} AS dd60,
      {r(f'(CASE WHEN count(close) OVER {last(20)} = 20 THEN close / avg(close) OVER {last(20)} - 1 END)')} AS ma20_gap FROM moved""",
}


def indicators(s, d) -> DataFrame:
    return compute(brand_week(s, d), _TABLE, 6)


@QUERIES.add(query("SELECT * FROM told", "panel", **_TABLE_SQL))
def etf_indicators(s, d):
    return indicators(s, d)


_WEIGHTS = {"mom20": 0.45, "mom60": 0.30, "trend50": 0.15, "vol20": -0.10, "dd60": 0.05}
_ELIGIBLE = "mom20 > 0 AND rsi14 < 80 AND ma20_gap > 0 AND dd60 > -0.99"


def rotation_scores(s, d) -> DataFrame:
    return pt.zscore_score(indicators(s, d).dropna(), _WEIGHTS, F.expr(_ELIGIBLE))


def _z(c: str) -> str:
    return f"CASE WHEN stddev_pop({c}) OVER (PARTITION BY date) > 1e-12 THEN ({c} - avg({c}) OVER (PARTITION BY date)) / stddev_pop({c}) OVER (PARTITION BY date) ELSE 0 END"


@QUERIES.add(query(f"SELECT date, code, {r('(' + ' + '.join(f'({w}) * ({_z(c)})' for c, w in _WEIGHTS.items()) + ')')} AS score FROM (SELECT * FROM told WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _TABLE)} AND {_ELIGIBLE})", "panel", **_TABLE_SQL))
def etf_score(s, d):
    return rotation_scores(s, d)


@QUERIES.add(query(
    f"""SELECT date, {r('close')} AS close, {r(f'(CASE WHEN k >= 20 THEN avg(close) OVER w20 END)')} AS ma20, {r('(CASE WHEN k >= 60 THEN avg(close) OVER w60 END)')} AS ma60, {r('(close / lag(close) OVER o - 1)')} AS ret1, {r('(close / lag(close, 5) OVER o - 1)')} AS ret5,
      CASE WHEN close / lag(close) OVER o - 1 <= -0.03 OR close / lag(close, 5) OVER o - 1 <= -0.06 THEN 'CRASH' WHEN (k >= 60 AND close < avg(close) OVER w60) OR (k >= 20 AND close < avg(close) OVER w20) THEN 'BEAR' ELSE 'BULL' END AS regime
      FROM (SELECT *, row_number() OVER (ORDER BY date) AS k FROM market) WINDOW o AS (ORDER BY date), w20 AS (ORDER BY date ROWS 19 PRECEDING), w60 AS (ORDER BY date ROWS 59 PRECEDING)""",
    "panel", market=f"SELECT date, {r('avg(close)', 4)} AS close FROM panel GROUP BY date"))
def market_regime(s, d):
    m = market(s, d)
    return m.select("date", *[rounded(F.col(c), 6).alias(c) for c in ("close", "ma20", "ma60", "ret1", "ret5")], "regime")


def market(s, d) -> DataFrame:
    """The mean close of all codes as a market index, with its regime; a row a date, in one order."""
    order = Window.orderBy("date")
    m = brand_week(s, d).groupBy("date").agg(rounded(F.avg("close"), 4).alias("close")).withColumn("k", F.row_number().over(order))
    mean = lambda n: F.when(F.col("k") >= n, F.avg("close").over(order.rowsBetween(1 - n, 0)))
    back = lambda n: F.try_divide("close", F.lag("close", n).over(order)) - 1
    m = m.withColumns({"ma20": mean(20), "ma60": mean(60), "ret1": back(1), "ret5": back(5)})
    return m.withColumn("regime", lg.regime(F.col("ret1"), F.col("ret5"), F.col("close"), F.col("ma20"), F.col("ma60")))


def rotation_days(s, d) -> DataFrame:
    """What a rotation sees: score and regime of the week before, the week's return."""
    panel = brand_week(s, d)
    code = Window.partitionBy("code").orderBy("date")
    own = panel.join(rotation_scores(s, d), ["date", "code"], "left")
    own = own.select("date", "code", "sector", F.lag("score").over(code).alias("score"), (F.try_divide("close", F.lag("close").over(code)) - 1).alias("ret"))
    m = market(s, d).select("date", F.lag("regime").over(Window.orderBy("date")).alias("regime"), "k").filter("k > 63")
    return own.join(F.broadcast(m.drop("k")), "date")


@QUERIES.add(None)
def rotation_weights(s, d):
    sectors = brand_week(s, d).select("date", "code", "sector")
    return lg.rotation_weights(rotation_scores(s, d).join(sectors, ["date", "code"])).withColumn("weight", rounded(F.col("weight"), 6))


@QUERIES.add(None)
def etf_rotation(s, d):
    return lg.rotate(rotation_days(s, d), {"base": lg.Rotation(defensive=("sector0",), stop=0.5, alert=0.2, alert2=0.35)})


@QUERIES.add(None)
def rotation_tuning(s, d):
    grid = {"stop": [0.3, 0.5], "alert": [0.1, 0.2], "risk_alert": [0.3, 0.5], "bear_budget": [0.2, 0.3]}
    return lg.tuned(rotation_days(s, d), grid, lg.Rotation(defensive=("sector0",), alert2=0.25), 52)


_BANDS = {"rsi": "100 - 100 / (1 + MEAN(GREATEST(DELTA(close, 1), 0), 14) / MEAN(GREATEST(-1 * DELTA(close, 1), 0), 14))", "lower": "MEAN(close, 20) - 2 * STD1(close, 20)", "upper": "MEAN(close, 20) + 2 * STD1(close, 20)", "close_": "close"}


@QUERIES.add(query(
    f"""SELECT code, CASE WHEN rsi < 30 THEN 'BUY' WHEN close < lower THEN 'BUY' WHEN rsi > 70 THEN 'SELL' WHEN close > upper THEN 'SELL' ELSE 'HOLD' END AS signal,
      CASE WHEN rsi < 30 THEN 'oversold' WHEN close < lower THEN 'below band' WHEN rsi > 70 THEN 'overbought' WHEN close > upper THEN 'above band' ELSE '' END AS reason,
      {r('(CASE WHEN rsi < 30 THEN 100 - rsi WHEN close < lower THEN 80 WHEN rsi > 70 THEN 0 WHEN close > upper THEN 20 ELSE 50 END)', 4)} AS score FROM
      (SELECT date, code, close, rsi14 AS rsi, avg(close) OVER {last(20)} - 2 * stddev_samp(close) OVER {last(20)} AS lower, avg(close) OVER {last(20)} + 2 * stddev_samp(close) OVER {last(20)} AS upper FROM panel JOIN told USING (date, code)) QUALIFY date = max(date) OVER (PARTITION BY code)""",
    "panel", **_TABLE_SQL))
def mean_revert_signal(s, d):
    bands = compute(brand_week(s, d), _BANDS, 6)
    return pt.revert_signals(bands.withColumnRenamed("close_", "close"))


@QUERIES.add(query(f"SELECT date, code, {r('(1 - greatest(0, least(1, (close - lo) / nullif(hi - lo, 0))))')} AS position, {r('(close * 0.98)', 2)} AS next_buy, {r('(close * 1.02)', 2)} AS next_sell, close BETWEEN lo AND hi AS in_range FROM (SELECT date, code, close, min(low) OVER (PARTITION BY code ORDER BY date) AS lo, max(high) OVER (PARTITION BY code ORDER BY date) AS hi FROM panel)", "panel"))
def grid_position(s, d):
    """The range is that of a code's rows so far."""
    so_far = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return pt.grid_positions(brand_week(s, d).withColumns({"lo": F.min("low").over(so_far), "hi": F.max("high").over(so_far)}))


# trades and ledgers

_TRADES = "SELECT l_suppkey AS account, l_shipdate AS time, l_orderkey, l_linenumber, l_partkey AS code, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS qty, l_extendedprice AS notional FROM lineitem"


def trades(s, d) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    return table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("code"), F.col("l_shipdate").alias("time"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), side.alias("side"), F.col("l_quantity").alias("qty"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_extendedprice").alias("notional"), F.greatest(F.col("l_extendedprice") * 0.0003, F.lit(5.0)).alias("fee"), "l_orderkey", "l_linenumber",
    )


_MAIN = "('0', '3', '4', '6', '8')"
_CODE = "concat(CASE code % 5 WHEN 0 THEN '688' WHEN 1 THEN '300' WHEN 2 THEN '600' WHEN 3 THEN '830' ELSE '430' END, CAST(code % 1000 AS VARCHAR))"


def _board(c):
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in ("688", "300", "600", "830", "430")]), (c % 5 + 1).cast("int")), (c % 1000).cast("string"))


@QUERIES.add(f"""SELECT l_orderkey, l_linenumber, symbol, shares, CASE WHEN symbol LIKE '688%' THEN CASE WHEN shares < 200 THEN 0 ELSE least(shares, 100000) END WHEN symbol LIKE '4%' OR symbol LIKE '8%' THEN CASE WHEN shares < 100 THEN 0 ELSE least(shares, 1000000) END
  WHEN symbol LIKE '30%' THEN least(shares // 100 * 100, 300000) ELSE least(shares // 100 * 100, 1000000) END AS lots FROM (SELECT l_orderkey, l_linenumber, {_CODE} AS symbol, CAST(floor(qty * qty * 397) AS BIGINT) AS shares FROM ({_TRADES}) t) q""")  # fmt: skip
def lot_size(s, d):
    own = trades(s, d).select("l_orderkey", "l_linenumber", _board(F.col("code")).alias("symbol"), F.floor(F.col("qty") * F.col("qty") * 397).cast("long").alias("shares"))
    return own.withColumn("lots", lg.lots(F.col("symbol"), F.col("shares")))


@QUERIES.add(f"SELECT l_orderkey, l_linenumber, side, {r('(greatest(notional * 0.0003, 5) + CASE WHEN side = ' + chr(39) + 'SELL' + chr(39) + ' THEN notional * 0.001 ELSE 0 END)', 4)} AS fee FROM ({_TRADES}) t")
def a_share_fee(s, d):
    fee = F.greatest(F.col("notional") * 0.0003, F.lit(5.0)) + F.when(F.col("side") == "SELL", F.col("notional") * 0.001).otherwise(0.0)
    return trades(s, d).select("l_orderkey", "l_linenumber", "side", rounded(fee, 4).alias("fee"))


@QUERIES.add(f"SELECT account, {r('(sum(abs(notional)) / (2 * avg(equity)))', 4)} AS turnover FROM (SELECT account, notional, sum(notional) OVER (PARTITION BY account) / 4 AS equity FROM ({_TRADES}) t) q GROUP BY account")
def notional_turnover(s, d):
    """What was traded over twice the mean equity, for which a quarter of all trades stands in."""
    own = trades(s, d).groupBy("account").agg(F.sum(F.abs("notional")).alias("moved"), (F.sum("notional") / 4).alias("equity"))
    return own.select("account", rounded(F.try_divide("moved", 2 * F.col("equity")), 4).alias("turnover"))


@QUERIES.add(f"SELECT coalesce(side, 'all') AS side, coalesce(CAST(account % 5 AS VARCHAR), 'all') AS book, grouping(side, account % 5) AS level, {r('sum(CAST(notional AS DECIMAL(18,2)))::DOUBLE', 2)} AS notional, {r(f'(sum(CAST(notional AS DECIMAL(18,2)))::DOUBLE / (SELECT sum(CAST(notional AS DECIMAL(18,2)))::DOUBLE FROM ({_TRADES}) u))')} AS share FROM ({_TRADES}) t GROUP BY GROUPING SETS ((side), (account % 5), (side, account % 5))")
def attribution(s, d):
    """By side, by book and by both in one pass of grouping sets."""
    own = trades(s, d).select("side", (F.col("account") % 5).alias("book"), F.col("notional").cast("decimal(18,2)").alias("notional"))
    total = own.agg(F.sum("notional").cast("double").alias("total"))
    g = own.groupingSets([["side"], ["book"], ["side", "book"]], "side", "book").agg(F.grouping_id("side", "book").cast("long").alias("level"), F.sum("notional").cast("double").alias("notional"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in ("side", "book")]
    return g.join(F.broadcast(total)).select(*named, "level", rounded(F.col("notional"), 2).alias("notional"), rounded(F.col("notional") / F.col("total"), 6).alias("share"))


@QUERIES.add(f"SELECT account, code, {r('sum(CASE WHEN side = ' + chr(39) + 'BUY' + chr(39) + ' THEN qty ELSE -qty END)', 2)} AS quantity, count(*) AS trades FROM ({_TRADES}) t GROUP BY account, code")
def position_net(s, d):
    signed = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))
    return trades(s, d).groupBy("account", "code").agg(rounded(F.sum(signed), 2).alias("quantity"), F.count("*").alias("trades"))


@QUERIES.add(query(f"SELECT date, {r('sum(w * w)')} AS hhi, {r('(sum(w) FILTER (k <= 5))')} AS top5, any_value(s) AS sectors FROM held JOIN (SELECT date, string_agg(sector || '=' || printf('%.4f', w), ',' ORDER BY sector) AS s FROM (SELECT date, sector, {r('sum(w)')} AS w FROM held GROUP BY ALL) GROUP BY date) USING (date) GROUP BY date", "panel", held="SELECT date, code, sector, w, row_number() OVER (PARTITION BY date ORDER BY w DESC, code) AS k FROM (SELECT date, code, sector, amount / sum(amount) OVER (PARTITION BY date) AS w FROM panel)"))
def concentration(s, d):
    share = F.try_divide("amount", F.sum("amount").over(Window.partitionBy("date")))
    return pt.concentration(brand_week(s, d).select("date", "code", "sector", share.alias("weight")))


@QUERIES.add(query(f"SELECT date, sector, {r('(sum(amount) / any_value(total))')} AS weight FROM panel JOIN (SELECT date, sum(amount) AS total FROM panel GROUP BY date) USING (date) GROUP BY date, sector", "panel"))
def sector_weights(s, d):
    own = brand_week(s, d).groupBy("date", "sector").agg(F.sum("amount").alias("a"))
    return own.select("date", "sector", rounded(F.try_divide("a", F.sum("a").over(Window.partitionBy("date"))), 6).alias("weight"))


_STEP = """struct_pack(h := CASE WHEN x.side = 'BUY' THEN a.h + x.q ELSE a.h - least(x.q, a.h) END,
  c := CASE WHEN x.side = 'BUY' AND a.h + x.q <> 0 THEN (a.c * a.h + x.q * x.p + x.f) / (a.h + x.q) WHEN x.side = 'BUY' THEN 0.0 ELSE a.c END,
  r := CASE WHEN x.side = 'BUY' THEN a.r ELSE a.r + least(x.q, a.h) * (x.p - a.c) - x.f END, side := '', q := 0.0::DOUBLE, p := 0.0::DOUBLE, f := 0.0::DOUBLE)"""
_ONE = "struct_pack(h := 0.0::DOUBLE, c := 0.0::DOUBLE, r := 0.0::DOUBLE, side := side, q := coalesce(qty, 0.0)::DOUBLE, p := coalesce(price, 0.0)::DOUBLE, f := coalesce(fee, 0.0)::DOUBLE)"
_START = "struct_pack(h := 0.0::DOUBLE, c := 0.0::DOUBLE, r := 0.0::DOUBLE, side := '', q := 0.0::DOUBLE, p := 0.0::DOUBLE, f := 0.0::DOUBLE)"
_LEDGER = f"""SELECT account, code, s.h AS quantity, s.c AS cost, s.r AS realized FROM (SELECT account, code, list_reduce(list_prepend({_START}, list({_ONE} ORDER BY time, seq, side, qty, price, fee)), lambda a, x: {_STEP}) AS s
  FROM (SELECT *, l_orderkey * 10 + l_linenumber AS seq, notional / nullif(qty, 0) AS price, greatest(notional * 0.0003, 5) AS fee FROM ({_TRADES}) t0) t GROUP BY account, code) q"""


@QUERIES.add(f"SELECT account, code, {r('quantity')} AS quantity, {r('cost')} AS cost, {r('realized')} AS realized FROM ({_LEDGER}) l")
def position_ledger(s, d):
    return lg.position_ledger(trades(s, d)).select("account", "code", *[rounded(F.col(c), 6).alias(c) for c in ("quantity", "cost", "realized")])


@QUERIES.add(None)
def sleeve_ledger(s, d):
    """Each sector a portfolio of its brands, equal weights, rebalanced by month."""
    panel = brand_week(s, d)
    n = panel.groupBy("sector").agg(F.count_distinct("code").alias("n"))
    own = panel.join(F.broadcast(n), "sector")
    mean = F.avg("close").over(Window.partitionBy("date"))
    return lg.sleeve_ledger(own.select(F.col("sector").alias("portfolio"), "date", F.col("code").alias("sleeve"), (1.0 / F.col("n")).alias("weight"), F.col("close").alias("nav"), mean.alias("benchmark")))


@QUERIES.add(None)
def target_execution(s, d):
    """The month-end targets of two strategies, carried out on weekly bars whose codes stand for boards."""
    panel = brand_week(s, d)
    number = F.regexp_extract("code", r"(\d+)", 1).cast("int")
    named = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("600", "300", "688", "830")]), (number % 4 + 1).cast("int")), F.lpad(number.cast("string"), 3, "0"))
    bars = panel.select("date", named.alias("code"), (F.col("close") / 100).alias("close"))
    ends = F.broadcast(pt.rebalance_dates(panel, "monthly"))
    best = pt.target_weights(scores(s, d), 8).join(ends, "date").select(F.lit("best").alias("strategy"), "date", named.alias("code"), "weight")
    small = pt.smallest(panel, panel.join(ends, "date").select("date"), 5, 10).select(F.lit("small").alias("strategy"), "date", named.alias("code"), (F.col("weight") * 0.9).alias("weight"))
    return lg.execute_targets(bars, best.unionByName(small))


@QUERIES.add(None)
def breakout_machine(s, d):
    told = compute(brand_week(s, d), {"rsi": _TABLE["rsi14"], "wr": "50 - 100 * (TSMAX(high, 32) - close) / (TSMAX(high, 32) - TSMIN(low, 32))"}, 6)
    return lg.breakout_machine(brand_week(s, d).join(told, ["date", "code"]), cooldown=6)


@QUERIES.add(query("SELECT date, code, " + ", ".join(f"{x} AS {k}" for k, x in {
    "ret_1d": r("(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1)"), "ret_5d": r("(close / lag(close, 5) OVER (PARTITION BY code ORDER BY date) - 1)"), "ret_60d": r("(close / lag(close, 60) OVER (PARTITION BY code ORDER BY date) - 1)"),
    "volatility_20d": r(f"(CASE WHEN count(ret) OVER {last(20)} = 20 THEN stddev_samp(ret) OVER {last(20)} END)"),
}.items()) + " FROM moved", "panel", moved=_TABLE_SQL["moved"]))
def strategy_features(s, d):
    return compute(brand_week(s, d), {"ret_1d": "RET(close, 1)", "ret_5d": "RET(close, 5)", "ret_60d": "RET(close, 60)", "volatility_20d": "STD1(returns, 20)"}, 6)
