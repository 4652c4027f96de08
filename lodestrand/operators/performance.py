"""Analytics of NAV series, over frames (strategy, date, nav, benchmark). Windows run along a strategy's own dates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.panel_ops import pair_corr
from lodestrand.plans.layers import rounded

def _own():
    return Window.partitionBy("strategy").orderBy("date")


def _so_far():
    return _own().rowsBetween(Window.unboundedPreceding, 0)


def nav_of(panel: DataFrame) -> DataFrame:
    """(strategy, date, nav, benchmark) of a panel: each code's close over its first, with the mean of all codes of the date."""
    first = F.first("close").over(Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    own = panel.select(F.col("code").alias("strategy"), "date", F.try_divide("close", first).alias("nav"))
    return own.select("strategy", "date", rounded(F.col("nav"), 8).alias("nav"), rounded(F.avg("nav").over(Window.partitionBy("date")), 8).alias("benchmark"))


def returns_of(nav: DataFrame) -> DataFrame:
    """``nav`` with r and b, the returns of the series and of its benchmark since the row before."""
    step = lambda c: F.try_divide(c, F.lag(c).over(_own())) - 1
    return nav.withColumns({"r": step("nav"), "b": step("benchmark")})


def aligned(nav: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``nav`` (strategy, date, nav) with the latest value of ``benchmark`` (date, benchmark) up to each date, 1 before its first."""
    joined = nav.join(benchmark, "date", "left")
    return joined.withColumn("benchmark", F.coalesce(F.last("benchmark", ignorenulls=True).over(_so_far()), F.lit(1.0)))


def metrics(nav: DataFrame, periods: int = 252, population: bool = True) -> DataFrame:
    """A row a strategy: observations, returns, volatilities, drawdown, ratios, beta, alpha, tracking error, value at risk, win rate.

    Annual figures take ``periods`` rows a year; deviations are of the population, or of a sample. What divides by nothing is NULL."""
    rows = returns_of(nav).withColumn("fall", F.try_divide(F.col("nav"), F.max("nav").over(_so_far())) - 1)
    std = F.stddev_pop if population else F.stddev_samp
    year, root = float(periods), float(periods) ** 0.5
    g = rows.groupBy("strategy").agg(
        F.count("*").alias("observations"), F.min_by("nav", "date").alias("n0"), F.max_by("nav", "date").alias("n1"), F.min_by("benchmark", "date").alias("b0"), F.max_by("benchmark", "date").alias("b1"),
        F.count("r").alias("k"), F.avg("r").alias("m"), F.avg("b").alias("mb"), (std("r") * root).alias("vol"), std("r").alias("s"), (F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least("r", F.lit(0.0)), 2)))) * root).alias("down"), (-F.min("fall")).alias("dd"),
        F.covar_pop("r", "b").alias("cov"), F.var_pop(F.when(F.col("r").isNotNull(), F.col("b"))).alias("vb"), (std(F.col("r") - F.col("b")) * root).alias("te"), F.avg(F.col("r") - F.col("b")).alias("excess"), F.avg((F.col("r") > 0).cast("double")).alias("win"),
    )
    total, market = F.try_divide("n1", "n0") - 1, F.try_divide("b1", "b0") - 1
    annual = F.when(total > -1, F.pow(1 + total, year / F.greatest(F.col("k"), F.lit(1))) - 1).otherwise(-1.0)
    over = lambda a, b: F.when(F.abs(b) > 1e-12, a / b)
    beta = over(F.col("cov"), F.col("vb"))
    out = {
        "total_return": total, "annual_return": annual, "benchmark_return": market, "excess_return": total - market, "volatility": F.col("vol"), "downside": F.col("down"), "max_drawdown": F.col("dd"),
        "sharpe": over(F.col("m") * year, F.col("vol")), "sortino": over(F.col("m") * year, F.col("down")), "calmar": over(annual, F.col("dd")), "beta": beta, "alpha": F.col("m") * year - F.coalesce(beta, F.lit(0.0)) * F.col("mb") * year,
        "tracking_error": F.col("te"), "information_ratio": over(F.col("excess") * year, F.col("te")), "var_95": F.col("m") - 1.645 * F.col("s"), "win_rate": F.col("win"),
    }
    return g.select("strategy", "observations", *[rounded(c, 5).alias(k) for k, c in out.items()])


def kpis(nav: DataFrame) -> DataFrame:
    """(strategy, days, total_return, annual_return, volatility, sharpe, max_drawdown) with calendar days for the year and sample deviations."""
    rows = returns_of(nav).withColumn("fall", F.try_divide(F.col("nav"), F.max("nav").over(_so_far())) - 1)
    g = rows.groupBy("strategy").agg(F.min_by("nav", "date").alias("n0"), F.max_by("nav", "date").alias("n1"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("r").alias("k"), F.min("fall").alias("dd"))
    total, year = F.try_divide("n1", "n0") - 1, F.try_divide(F.col("k") * 365.25, F.col("days"))
    annual = F.when((F.col("days") > 0) & (total > -1), F.pow(1 + total, 365.25 / F.nullif(F.col("days"), F.lit(0))) - 1)
    return g.select(
        "strategy", F.col("days").cast("long").alias("days"), rounded(total, 5).alias("total_return"), rounded(annual, 5).alias("annual_return"), rounded(F.col("s") * F.sqrt(year), 5).alias("volatility"),
        rounded(F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * F.sqrt(year)), 5).alias("sharpe"), rounded(F.col("dd"), 5).alias("max_drawdown"),
    )


def period_returns(nav: DataFrame, unit: str) -> DataFrame:
    """(strategy, period, ret): the last value of a "month", "quarter" or "year" over the last of the period before."""
    last = nav.groupBy("strategy", F.to_date(F.date_trunc(unit, "date")).alias("period")).agg(F.max_by("nav", "date").alias("nav"))
    before = F.lag("nav").over(Window.partitionBy("strategy").orderBy("period"))
    return last.select("strategy", "period", rounded(F.try_divide("nav", before) - 1, 5).alias("ret"))


def drawdown_events(nav: DataFrame, least: float = 0.02, keep: int | None = 5) -> DataFrame:
    """(strategy, start, trough, recovered, depth, days) of the falls of ``least`` and more from a peak: the peak's date, the date of the
    lowest value, the date of the first value that is back, NULL if none is, and rows below. The last ``keep`` of a strategy."""
    rows = nav.withColumn("peak", F.max("nav").over(_so_far())).withColumn("high", F.sum((F.col("nav") >= F.col("peak")).cast("int")).over(_so_far()))
    spells = rows.groupBy("strategy", "high").agg(
        F.min("date").alias("start"), F.max("peak").alias("peak"), F.min(F.struct(F.col("nav"), F.col("date"))).alias("low"), F.sum((F.col("nav") < F.col("peak")).cast("int")).alias("days")
    )
    spells = spells.withColumn("recovered", F.lead("start").over(Window.partitionBy("strategy").orderBy("high")))
    depth = F.try_divide(F.col("low.nav"), F.col("peak")) - 1
    falls = spells.select("strategy", "start", F.col("low.date").alias("trough"), "recovered", depth.alias("depth"), F.col("days").cast("long").alias("days")).filter((F.col("days") > 0) & (F.col("depth") < -least))
    if keep is not None:
        falls = falls.withColumn("k", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("start")))).filter(F.col("k") <= keep).drop("k")
    return falls.withColumn("depth", rounded(F.col("depth"), 5))


def underwater(nav: DataFrame) -> DataFrame:
    """(strategy, longest): the most calendar days between a peak and the next value as high, or the last value."""
    rows = nav.withColumn("peak", F.max("nav").over(_so_far())).withColumn("high", F.sum((F.col("nav") >= F.col("peak")).cast("int")).over(_so_far()))
    spells = rows.groupBy("strategy", "high").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    following = F.coalesce(F.lead("start").over(Window.partitionBy("strategy").orderBy("high")), F.col("end"))
    return spells.withColumn("gap", F.datediff(following, F.col("start"))).groupBy("strategy").agg(F.max("gap").cast("long").alias("longest"))


def inverse_vol_weights(returns: DataFrame, least: int = 20) -> DataFrame:
    """(strategy, weight): one over the deviation of returns, as shares, to four places; equal weights if there are fewer than
    ``least`` dates on which all strategies have a return. A row a strategy, so the shares take one task."""
    n = returns.select("strategy").distinct().agg(F.count("*").alias("strategies"))
    common = returns.filter("r IS NOT NULL").groupBy("date").agg(F.count_distinct("strategy").alias("k")).join(F.broadcast(n)).agg(F.count(F.when(F.col("k") == F.col("strategies"), 1)).alias("common"))
    v = returns.groupBy("strategy").agg(F.stddev_samp("r").alias("v")).join(F.broadcast(common))
    share = F.try_divide(F.lit(1.0), "v")
    every = Window.partitionBy()
    return v.select("strategy", rounded(F.when(F.col("common") < least, 1 / F.count("*").over(every)).otherwise(share / F.sum(share).over(every)), 4).alias("weight"))


def combined_levels(nav: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, strategies, nav): the weighted mean of levels on each date with any, over the first; weights of those there count."""
    own = nav.join(F.broadcast(weights), "strategy")
    days = own.groupBy("date").agg(F.count("*").alias("strategies"), (F.sum(F.col("weight") * F.col("nav")) / F.sum("weight")).alias("level"))
    first = days.agg(F.min_by("level", "date").alias("first"))
    return days.join(F.broadcast(first)).select("date", "strategies", rounded(F.try_divide("level", "first"), 6).alias("nav"))


def combined_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, r, log_nav): the weighted sum of returns on dates on which all strategies have one, and the logarithm of what they compound to. A row a date, in one order."""
    n = weights.agg(F.count("*").alias("strategies"))
    days = returns.filter("r IS NOT NULL").join(F.broadcast(weights), "strategy").groupBy("date").agg(F.sum(F.col("weight") * F.col("r")).alias("r"), F.count("*").alias("k"))
    days = days.join(F.broadcast(n)).filter("k = strategies")
    grown = F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-9)))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return days.select("date", rounded(F.col("r"), 6).alias("r"), rounded(grown, 6).alias("log_nav"))


def strategy_corr(returns: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, corr) of the returns of a few strategies on the dates that all have; 0 where one doesn't move. One wide aggregate."""
    wide = returns.filter(F.col("strategy").isin(names)).groupBy("date").pivot("strategy", names).agg(F.first("r"))
    wide = wide.dropna(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = wide.agg(*[F.coalesce(pair_corr(F.col(f"`{a}`"), F.col(f"`{b}`")), F.lit(0.0)).alias(f"{k}") for k, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{k}`").alias("corr")) for k, (a, b) in enumerate(pairs)])
    return found.select(F.explode(each).alias("x")).select("x.a", "x.b", rounded(F.col("x.corr"), 6).alias("corr"))


def recent(nav: DataFrame, days: int | None, fallback: int = 20) -> DataFrame:
    """The rows of a strategy's last ``days`` calendar days (None: all); if those are fewer than two, its last ``fallback`` rows."""
    if days is None:
        return nav
    own = Window.partitionBy("strategy")
    rows = nav.withColumns({"last": F.max("date").over(own), "place": F.row_number().over(own.orderBy(F.desc("date")))})
    rows = rows.withColumn("inside", F.col("date") > F.date_sub("last", days)).withColumn("k", F.sum(F.col("inside").cast("int")).over(own))
    return rows.filter(F.when(F.col("k") >= 2, F.col("inside")).otherwise(F.col("place") <= fallback)).select(nav.columns)


def leaderboard(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """(strategy, run, runs, sharpe, annual_return, place): the latest run of each strategy, places by Sharpe and then annual return."""
    latest = runs.groupBy("strategy").agg(F.max("run").alias("run"), F.count("*").alias("runs"))
    own = metrics.join(latest, ["strategy", "run"])
    place = F.rank().over(Window.orderBy(F.desc_nulls_last("sharpe"), F.desc_nulls_last("annual_return")))
    return own.select("strategy", "run", "runs", "sharpe", "annual_return", place.cast("long").alias("place"))


#: Limits of the risk rules.
RULES = {"max_drawdown": 0.20, "volatility": 0.30, "top1_weight": 0.20, "top5_weight": 0.60, "turnover": 5.0, "gross_exposure": 1.05}


def risk_rules(values: DataFrame, rules: Mapping[str, float] = RULES, key: str = "strategy") -> DataFrame:
    """(key, rule, threshold, current, triggered) for every rule; a value that is missing counts as 0."""
    at = lambda k: F.coalesce(F.col(k), F.lit(0.0)) if k in values.columns else F.lit(0.0)
    each = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(float(v)).alias("threshold"), at(k).alias("current")) for k, v in rules.items()])
    told = values.select(key, F.explode(each).alias("x"))
    return told.select(key, "x.rule", "x.threshold", "x.current", (F.col("x.current") > F.col("x.threshold")).alias("triggered"))


def quality_gate(nav: DataFrame, trades: DataFrame, holdings: DataFrame, end: Column, max_gross: float = 1.05, least_trades: int = 1) -> DataFrame:
    """A row a strategy with what keeps its result from being used: dates that don't increase, no date that reaches ``end`` (a column of ``nav`` or a literal), values that aren't
    finite or positive, a flat NAV, gross exposure above the cap, too few trades, trades on one side only, no turnover; and passed."""
    order = F.lag("date").over(Window.partitionBy("strategy").orderBy("seq"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) >= 1.7e308) | (F.col(c) <= 0)
    curve = nav.withColumn("before", order).groupBy("strategy").agg(
        F.max((F.col("date") <= F.col("before")).cast("int")).alias("back"), F.max((F.col("date") >= end).cast("int")).alias("reached"), F.max((bad("nav") | bad("benchmark")).cast("int")).alias("bad"), (F.max("nav") - F.min("nav")).alias("range")
    )
    gross = holdings.groupBy("strategy", "date").agg(F.sum(F.abs("weight")).alias("gross")).groupBy("strategy").agg(F.max("gross").alias("gross"))
    sides = trades.groupBy("strategy").agg(F.count("*").alias("trades"), F.count_distinct(F.upper("side")).alias("sides"), F.sum(F.abs("notional")).alias("moved"))
    out = curve.join(gross, "strategy", "left").join(sides, "strategy", "left")
    checks = {
        "out_of_order": F.coalesce(F.col("back") == 1, F.lit(False)), "stale": F.col("reached") == 0, "not_finite": F.col("bad") == 1, "flat": ~(F.col("range") > 1e-12), "over_exposed": F.coalesce(F.col("gross") > max_gross, F.lit(False)),
        "few_trades": F.coalesce("trades", F.lit(0)) < least_trades, "one_sided": F.coalesce("sides", F.lit(0)) < 2, "no_turnover": F.coalesce("moved", F.lit(0.0)) <= 0,
    }
    failed = sum((c.cast("int") for c in checks.values()), F.lit(0))
    return out.select("strategy", *[c.alias(k) for k, c in checks.items()], (failed == 0).alias("passed"))
