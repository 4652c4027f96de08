"""Queries of NAV analytics: each brand of the panel is a strategy, weeks are its periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrand.operators import performance as pf
from lodestrand.plans.layers import rounded
from lodestrand.plans.oracles.frames import corr, query, r
from lodestrand.plans.registry import Registry
from lodestrand.sources.panel import brand_week, table

QUERIES = Registry()
WEEKS = 52
FEW = ["Brand#11", "Brand#22", "Brand#3", "Brand#14", "Brand#25"]


def nav(s, d):
    return pf.nav_of(brand_week(s, d))


def returns(s, d):
    return pf.returns_of(nav(s, d))


_FELL = {"fell": "SELECT strategy, date, nav / max(nav) OVER (PARTITION BY strategy ORDER BY date) - 1 AS fall FROM nav"}
_OVER = lambda a, b: f"(CASE WHEN abs({b}) > 1e-12 THEN {a} / {b} END)"
_RAW = {
    **_FELL,
    "ends": "SELECT strategy, count(*) AS observations, arg_min(nav, date) AS n0, arg_max(nav, date) AS n1, arg_min(benchmark, date) AS b0, arg_max(benchmark, date) AS b1 FROM nav GROUP BY strategy",
    "moves": f"""SELECT strategy, count(r) AS k, avg(r) AS m, avg(b) AS mb, stddev_pop(r) AS s, sqrt(avg(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0 END)) * sqrt({WEEKS}) AS down,
      covar_pop(r, b) AS cov, var_pop(b) AS vb, stddev_pop(r - b) * sqrt({WEEKS}) AS te, avg(r - b) AS excess, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS win FROM returns GROUP BY strategy""",
    "deep": "SELECT strategy, -min(fall) AS dd FROM fell GROUP BY strategy",
    "raw": f"""SELECT *, n1 / n0 - 1 AS total, b1 / b0 - 1 AS market, s * sqrt({WEEKS}) AS vol, CASE WHEN n1 / n0 > 0 THEN pow(n1 / n0, {WEEKS}.0 / greatest(k, 1)) - 1 ELSE -1 END AS annual, {_OVER('cov', 'vb')} AS beta
      FROM ends JOIN moves USING (strategy) JOIN deep USING (strategy)""",
}
_METRICS = {
    "total_return": "total", "annual_return": "annual", "benchmark_return": "market", "excess_return": "(total - market)", "volatility": "vol", "downside": "down", "max_drawdown": "dd", "sharpe": _OVER(f"(m * {WEEKS})", "vol"), "sortino": _OVER(f"(m * {WEEKS})", "down"),
    "calmar": _OVER("annual", "dd"), "beta": "beta", "alpha": f"(m * {WEEKS} - coalesce(beta, 0) * mb * {WEEKS})", "tracking_error": "te", "information_ratio": _OVER(f"(excess * {WEEKS})", "te"), "var_95": "(m - 1.645 * s)", "win_rate": "win",
}


@QUERIES.add(query("SELECT strategy, observations, " + ", ".join(f"{r(x, 5)} AS {k}" for k, x in _METRICS.items()) + " FROM raw", "returns", **_RAW))
def performance_window(s, d):
    return pf.metrics(nav(s, d), WEEKS)


_SAMPLES = {k: v.replace("stddev_pop", "stddev_samp") for k, v in _RAW.items()}


@QUERIES.add(query("SELECT strategy, observations, " + ", ".join(f"{r(x, 5)} AS {k}" for k, x in _METRICS.items()) + " FROM raw", "nav", later="SELECT * FROM nav WHERE date >= DATE '1999-01-01'",
    returns="SELECT strategy, date, nav / lag(nav) OVER w - 1 AS r, benchmark / lag(benchmark) OVER w - 1 AS b FROM later WINDOW w AS (PARTITION BY strategy ORDER BY date)", **{k: v.replace("FROM nav", "FROM later") for k, v in _SAMPLES.items()}))
def performance_of_samples(s, d):
    """With sample deviations, from a start date on."""
    return pf.metrics(nav(s, d).filter("date >= DATE '1999-01-01'"), WEEKS, population=False)


@QUERIES.add(query(
    f"""SELECT strategy, days, {r('(n1 / n0 - 1)', 5)} AS total_return, {r('(CASE WHEN days > 0 AND n1 / n0 > 0 THEN pow(n1 / n0, 365.25 / days) - 1 END)', 5)} AS annual_return,
      {r('(s * sqrt(k * 365.25 / days))', 5)} AS volatility, {r('(CASE WHEN s > 1e-12 THEN m / s * sqrt(k * 365.25 / days) END)', 5)} AS sharpe, {r('(-dd)', 5)} AS max_drawdown
      FROM (SELECT strategy, arg_min(nav, date) AS n0, arg_max(nav, date) AS n1, date_diff('day', min(date), max(date)) AS days FROM nav GROUP BY strategy)
      JOIN (SELECT strategy, avg(r) AS m, stddev_samp(r) AS s, count(r) AS k FROM returns GROUP BY strategy) USING (strategy) JOIN deep USING (strategy)""",
    "returns", **_FELL, deep=_RAW["deep"]))
def kpis(s, d):
    return pf.kpis(nav(s, d))


def _periods(unit: str) -> str:
    last = f"SELECT strategy, CAST(date_trunc('{unit}', date) AS DATE) AS period, arg_max(nav, date) AS nav FROM nav GROUP BY ALL"
    return query(f"SELECT strategy, period, {r('(nav / lag(nav) OVER (PARTITION BY strategy ORDER BY period) - 1)', 5)} AS ret FROM last", "nav", last=last)


@QUERIES.add(_periods("month"))
def monthly_returns(s, d):
    return pf.period_returns(nav(s, d), "month")


@QUERIES.add(_periods("year"))
def yearly_returns(s, d):
    return pf.period_returns(nav(s, d), "year")


_SPELLS = {
    "highs": "SELECT a.strategy, a.date, a.nav FROM nav a WHERE a.nav >= (SELECT max(b.nav) FROM nav b WHERE b.strategy = a.strategy AND b.date <= a.date)",
    "spans": "SELECT strategy, date AS start, nav AS peak, lead(date) OVER (PARTITION BY strategy ORDER BY date) AS recovered FROM highs",
    "lows": "SELECT s.strategy, s.start, s.recovered, min(n.nav) / any_value(s.peak) - 1 AS depth, arg_min(n.date, (n.nav, n.date)) AS trough, count(*) AS days FROM spans s JOIN nav n ON n.strategy = s.strategy AND n.date > s.start AND n.date < coalesce(s.recovered, DATE '9999-01-01') GROUP BY ALL",
}


@QUERIES.add(query(f"SELECT strategy, start, trough, recovered, {r('depth', 5)} AS depth, days FROM lows WHERE depth < -0.02 QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY start DESC) <= 5", "nav", **_SPELLS))
def drawdown_events(s, d):
    return pf.drawdown_events(nav(s, d))


@QUERIES.add(query("SELECT strategy, max(date_diff('day', start, coalesce(recovered, last))) AS longest FROM spans JOIN (SELECT strategy, max(date) AS last FROM nav GROUP BY strategy) USING (strategy) GROUP BY strategy", "nav", **_SPELLS))
def longest_underwater(s, d):
    return pf.underwater(nav(s, d))


_WEIGHTS = {
    "common": "SELECT count(*) AS n FROM (SELECT date FROM returns WHERE r IS NOT NULL GROUP BY date HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM returns))",
    "vols": "SELECT strategy, stddev_samp(r) AS v FROM returns GROUP BY strategy",
    "weights": f"SELECT strategy, {r('(CASE WHEN (SELECT n FROM common) < 20 THEN 1.0 / (SELECT count(*) FROM vols) ELSE 1 / v / (SELECT sum(1 / v) FROM vols) END)', 4)} AS weight FROM vols",
}


@QUERIES.add(query("SELECT * FROM weights", "returns", **_WEIGHTS))
def inverse_vol_weights(s, d):
    return pf.inverse_vol_weights(returns(s, d))


@QUERIES.add(query(f"SELECT date, n AS strategies, {r('(level / (SELECT arg_min(level, date) FROM days))')} AS nav FROM days", "returns", **_WEIGHTS, days="SELECT date, count(*) AS n, sum(weight * nav) / sum(weight) AS level FROM nav JOIN weights USING (strategy) GROUP BY date"))
def combined_nav(s, d):
    return pf.combined_levels(nav(s, d), pf.inverse_vol_weights(returns(s, d)))


@QUERIES.add(query(f"SELECT date, {r('r')} AS r, {r('(sum(ln(greatest(1 + r, 1e-9))) OVER (ORDER BY date))')} AS log_nav FROM days", "returns", **_WEIGHTS, days="SELECT date, sum(weight * r) AS r FROM returns JOIN weights USING (strategy) WHERE r IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(*) FROM weights)"))
def combined_returns(s, d):
    own = returns(s, d)
    return pf.combined_returns(own, pf.inverse_vol_weights(own))


_FEW_SQL = ", ".join(f"'{x}'" for x in FEW)
_AT = lambda a: f"list_position([{_FEW_SQL}], {a}.strategy)"


@QUERIES.add(query(f"SELECT a.strategy AS a, b.strategy AS b, {r('coalesce(' + corr('a.r', 'b.r') + ', 0)')} AS corr FROM own a JOIN own b ON a.date = b.date AND {_AT('a')} < {_AT('b')} GROUP BY ALL", "returns", own=f"SELECT * FROM returns WHERE strategy IN ({_FEW_SQL}) AND date IN (SELECT date FROM returns WHERE strategy IN ({_FEW_SQL}) AND r IS NOT NULL GROUP BY date HAVING count(*) = {len(FEW)})"))
def strategy_corr(s, d):
    return pf.strategy_corr(returns(s, d), FEW)


@QUERIES.add(query(f"SELECT date FROM nav WHERE strategy IN ({_FEW_SQL}) GROUP BY date HAVING count(DISTINCT strategy) = {len(FEW)}", "nav"))
def overlap_of_dates(s, d):
    return nav(s, d).filter(F.col("strategy").isin(FEW)).groupBy("date").agg(F.count_distinct("strategy").alias("k")).filter(F.col("k") == len(FEW)).select("date")


_RUNS = "year(date) % 3 + 1"


@QUERIES.add(query(
    f"""SELECT strategy, run, runs, sharpe, annual_return, rank() OVER (ORDER BY sharpe DESC NULLS LAST, annual_return DESC NULLS LAST) AS place FROM
      (SELECT strategy, run, max(run) OVER w AS latest, count(*) OVER w AS runs, {r('(CASE WHEN s > 1e-12 THEN m * 52 / (s * sqrt(52)) END)', 5)} AS sharpe, {r('(CASE WHEN g > 0 THEN pow(g, 52.0 / greatest(k, 1)) - 1 ELSE -1 END)', 5)} AS annual_return FROM each WINDOW w AS (PARTITION BY strategy)) WHERE run = latest""",
    "nav", own=f"SELECT strategy, date, nav, {_RUNS} AS run, nav / lag(nav) OVER (PARTITION BY strategy, {_RUNS} ORDER BY date) - 1 AS r FROM nav",
    each="SELECT strategy, run, count(r) AS k, avg(r) AS m, stddev_pop(r) AS s, arg_max(nav, date) / arg_min(nav, date) AS g FROM own GROUP BY strategy, run"))
def strategy_leaderboard(s, d):
    """Three runs a strategy, by year; the latest counts."""
    runs = nav(s, d).withColumn("run", F.year("date") % 3 + 1)
    apart = runs.withColumn("strategy", F.concat("strategy", F.lit("/"), "run"))
    told = pf.metrics(apart.drop("run"), WEEKS).withColumn("run", F.substring_index("strategy", "/", -1).cast("int")).withColumn("strategy", F.substring_index("strategy", "/", 1))
    out = pf.leaderboard(told, runs.select("strategy", "run").distinct())
    return out.select("strategy", F.col("run").cast("long").alias("run"), "runs", "sharpe", "annual_return", "place")


@QUERIES.add(query("SELECT strategy, date, nav FROM (SELECT strategy, date, nav, max(date) OVER w AS last, row_number() OVER (PARTITION BY strategy ORDER BY date DESC) AS k FROM nav WINDOW w AS (PARTITION BY strategy)) WHERE date > last - 90", "nav"))
def nav_period(s, d):
    return pf.recent(nav(s, d), 90).select("strategy", "date", "nav")


@QUERIES.add(query("SELECT strategy, date, nav FROM nav QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY date DESC) <= 20", "nav"))
def nav_period_fallback(s, d):
    """A period with one row at most falls back to the last twenty."""
    return pf.recent(nav(s, d), 1).select("strategy", "date", "nav")


@QUERIES.add(query(f"SELECT strategy, date, {r('nav')} AS nav, {r('coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY strategy ORDER BY date), 1.0)')} AS benchmark FROM nav LEFT JOIN (SELECT date, avg(nav) AS m FROM nav WHERE strategy IN ({_FEW_SQL}) AND month(date) % 2 = 0 GROUP BY date) USING (date)", "nav"))
def benchmark_align(s, d):
    """A benchmark with values in every other month, carried forward to the strategy's dates."""
    own = nav(s, d)
    market = own.filter(F.col("strategy").isin(FEW)).filter(F.month("date") % 2 == 0).groupBy("date").agg(F.avg("nav").alias("benchmark"))
    return pf.aligned(own.drop("benchmark"), market).select("strategy", "date", rounded(F.col("nav"), 6).alias("nav"), rounded(F.col("benchmark"), 6).alias("benchmark"))


_LIMITS = {"max_drawdown": ("dd", 0.2), "volatility": ("vol", 0.3), "top1_weight": ("t1", 0.2), "top5_weight": ("t5", 0.6), "turnover": ("0.0", 5.0), "gross_exposure": ("gross", 1.05)}
_HELD = {"held": "SELECT code AS strategy, amount / sum(amount) OVER () AS w FROM panel WHERE date = (SELECT max(date) FROM panel)", "placed": "SELECT w, row_number() OVER (ORDER BY w DESC) AS k FROM held"}
_TOPS = "(SELECT max(w) FROM held) AS t1, (SELECT sum(w) FROM placed WHERE k <= 5) AS t5, (SELECT sum(w) FROM held) AS gross"


@QUERIES.add(query(" UNION ALL ".join(f"SELECT strategy, '{k}' AS rule, {v!r} AS threshold, {r(x, 5)} AS current, {r(x, 5)} > {v!r} AS triggered FROM seen" for k, (x, v) in _LIMITS.items()), "returns", "panel", **_RAW, **_HELD, seen=f"SELECT strategy, dd, vol, {_TOPS} FROM raw"))
def risk_rules(s, d):
    panel = brand_week(s, d)
    last = panel.agg(F.max("date").alias("date"))
    day = panel.join(F.broadcast(last), "date").select("amount")
    total = day.agg(F.sum("amount").alias("total"), F.max("amount").alias("top"), F.slice(F.sort_array(F.collect_list("amount"), asc=False), 1, 5).alias("five"))
    book = total.select((F.col("top") / F.col("total")).alias("top1_weight"), (F.aggregate("five", F.lit(0.0), lambda a, b: a + b) / F.col("total")).alias("top5_weight"), F.lit(1.0).alias("gross_exposure"))
    own = pf.metrics(nav(s, d), WEEKS).select("strategy", "max_drawdown", "volatility").join(F.broadcast(book))
    return pf.risk_rules(own.withColumns({c: rounded(F.col(c), 5) for c in ("top1_weight", "top5_weight")}))


_TRADES = "SELECT p_brand AS strategy, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_extendedprice AS notional FROM lineitem JOIN part ON l_partkey = p_partkey"


@QUERIES.add(query(
    """SELECT strategy, out_of_order, stale, not_finite, flat, over_exposed, few_trades, one_sided, no_turnover, NOT (out_of_order OR stale OR not_finite OR flat OR over_exposed OR few_trades OR one_sided OR no_turnover) AS passed FROM
      (SELECT strategy, false AS out_of_order, max(date) < (SELECT max(date) FROM nav) AS stale, bool_or(nav <= 0 OR benchmark <= 0) AS not_finite, max(nav) - min(nav) <= 1e-12 AS flat, any_value(gross) > 1.05 AS over_exposed,
        coalesce(any_value(n), 0) < 1000 AS few_trades, coalesce(any_value(sides), 0) < 2 AS one_sided, coalesce(any_value(moved), 0) <= 0 AS no_turnover
       FROM nav LEFT JOIN gross USING (strategy) LEFT JOIN (SELECT strategy, count(*) AS n, count(DISTINCT side) AS sides, sum(notional) AS moved FROM trades GROUP BY strategy) USING (strategy) GROUP BY strategy)""",
    "nav", trades=_TRADES, gross="SELECT code AS strategy, max(w) AS gross FROM (SELECT code, amount / volume / 1000 AS w FROM panel) GROUP BY code"))
def quality_gate(s, d):
    panel = brand_week(s, d)
    parts = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("strategy"))
    lines = table(s, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    trades = lines.select("strategy", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_extendedprice").alias("notional"))
    holdings = panel.select(F.col("code").alias("strategy"), "date", (F.try_divide("amount", "volume") / 1000).alias("weight"))
    own = nav(s, d)
    end = own.agg(F.max("date").alias("end"))
    curve = own.withColumn("seq", F.col("date")).join(F.broadcast(end))
    return pf.quality_gate(curve, trades, holdings, F.col("end"), least_trades=1000)
