"""Scores, screens, target weights and declarative backtests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.panel_ops import average_rank
from lodestrand.plans.layers import rounded

def _date():
    return Window.partitionBy("date")


def mean_rank_score(frame: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(date, code, score): the mean of the percent ranks of the factors that a code has; NULL if it has none."""
    shares = [F.try_divide(average_rank(F.col(f), ["date"]), F.count(f).over(_date()).cast("double")) for f in factors]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in shares), F.lit(0.0))
    there = sum((F.col(f).isNotNull().cast("int") for f in factors), F.lit(0))
    return frame.select("date", "code", rounded(F.try_divide(total, there), 8).alias("score"))


def rank_sum_score(frame: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(date, code, score): weighted average ranks added up; NULL where a factor is missing."""
    ranks = [w * average_rank(F.col(f), ["date"]) for f, w in weights.items()]
    return frame.select("date", "code", rounded(sum(ranks[1:], ranks[0]), 6).alias("score"))


def zscore_score(frame: DataFrame, weights: Mapping[str, float], eligible: Column) -> DataFrame:
    """(date, code, score) of eligible rows with all inputs: weighted z-scores within the date (population deviation, 0 where nothing varies)."""
    own = frame.dropna(subset=list(weights)).filter(eligible)
    z = lambda c: F.when(F.stddev_pop(c).over(_date()) > 1e-12, (F.col(c) - F.avg(c).over(_date())) / F.stddev_pop(c).over(_date())).otherwise(0.0)
    parts = [w * z(c) for c, w in weights.items()]
    return own.select("date", "code", rounded(sum(parts[1:], parts[0]), 6).alias("score"))


def placed(scores: DataFrame) -> DataFrame:
    """Scores with top and bottom, places from either end (ties by code), and n, how many there are."""
    return scores.filter("score IS NOT NULL").withColumns({"top": F.row_number().over(_date().orderBy(F.desc("score"), "code")), "bottom": F.row_number().over(_date().orderBy("score", F.desc("code"))), "n": F.count("*").over(_date())})


def target_weights(scores: DataFrame, size: int = 50, cap: float = 0.10) -> DataFrame:
    """(date, code, weight) of the best ``size`` codes, equal, at most ``cap``."""
    return placed(scores).filter(F.col("top") <= size).select("date", "code", rounded(F.least(1.0 / F.least("n", F.lit(size)), F.lit(cap)), 6).alias("weight"))


def long_short_targets(scores: DataFrame, size: int = 50, cap: float = 0.10) -> DataFrame:
    """(date, code, side, weight): the best and worst codes, as many on either side and none on both, half the money each."""
    own = placed(scores).withColumn("leg", F.least(F.lit(size), F.floor(F.col("n") / 2))).filter("leg > 0 AND (top <= leg OR bottom <= leg)")
    weight = F.least(F.try_divide(F.lit(0.5), "leg"), F.lit(cap))
    long = F.col("top") <= F.col("leg")
    return own.select("date", "code", F.when(long, "long").otherwise("short").alias("side"), rounded(F.when(long, weight).otherwise(-weight), 6).alias("weight"))


def rebalance_dates(dates: DataFrame, every: str, as_of: str | None = None) -> DataFrame:
    """(date) on which to trade: "single" (the last), "daily", "weekly", "monthly" or "quarterly" (the last of each), or "as_of": the last up to a date."""
    own = dates.select("date").distinct()
    if every == "daily":
        return own
    if every in ("single", "as_of"):
        if every == "as_of":
            own = own.filter(F.col("date") <= F.lit(as_of).cast("date"))
        return own.agg(F.max("date").alias("date")).filter("date IS NOT NULL")
    unit = {"weekly": "week", "monthly": "month", "quarterly": "quarter"}[every]
    return own.groupBy(F.date_trunc(unit, "date").alias("period")).agg(F.max("date").alias("date")).select("date")


def horizon_backtest(scores: DataFrame, closes: DataFrame, horizon: int = 5, share: float = 0.1, size: int | None = None, least: int = 50, cost: float = 0.0015) -> DataFrame:
    """(date, n, long_only, long_short): enter the best (worst) codes of each date, leave ``horizon`` dates of the market's calendar later.

    A code without a close on that date counts in no mean. Dates with fewer than ``least`` codes, and those without an exit date, have
    no row. Legs have ``size`` codes, or ``share`` of all, one at least. Costs are taken once a leg."""
    days = closes.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("day"))
    exits = days.select((F.col("day") - horizon).alias("day"), F.col("date").alias("exit_date"))
    out = F.broadcast(days.join(exits, "day").select("date", "exit_date"))
    prices = closes.select("date", "code", "close")
    own = placed(scores).filter(F.col("n") >= least).join(out, "date").join(prices, ["date", "code"])
    own = own.join(prices.select(F.col("date").alias("exit_date"), "code", F.col("close").alias("exit_close")), ["exit_date", "code"], "left")
    own = own.withColumn("r", F.try_divide("exit_close", "close") - 1)
    leg = F.least(F.lit(size), F.col("n")) if size else F.greatest(F.lit(1), F.floor(F.col("n") * share))
    long, short = F.avg(F.when(F.col("top") <= leg, F.col("r"))), F.avg(F.when(F.col("bottom") <= leg, F.col("r")))
    return own.groupBy("date").agg(F.max("n").alias("n"), rounded(long - cost, 6).alias("long_only"), rounded(long - short - 2 * cost, 6).alias("long_short"))


def long_short_backtest(pairs: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """(date, r, log_nav, drawdown, turnover, n) of a daily long-short portfolio over complete pairs (date, code, value, fwd): legs by percent rank,
    returns of the legs' means, what they compound to as a logarithm, the fall from its peak, and the mean Jaccard turnover of both legs."""
    own = pairs.filter("value IS NOT NULL AND fwd IS NOT NULL").withColumns({"pr": average_rank(F.col("value"), ["date"]) / F.count("*").over(_date()), "n": F.count("*").over(_date())}).filter(F.col("n") >= least)
    own = own.withColumn("side", F.when(F.col("pr") >= 1 - share, 1).when(F.col("pr") <= share, -1))
    day = own.groupBy("date").agg(F.avg(F.when(F.col("side") == 1, F.col("fwd"))).alias("up"), F.avg(F.when(F.col("side") == -1, F.col("fwd"))).alias("down"), F.count("*").alias("n")).filter("up IS NOT NULL AND down IS NOT NULL")
    number = F.broadcast(day.select("date", F.row_number().over(Window.orderBy("date")).alias("day")))
    legs = own.filter("side IS NOT NULL").join(number, "date")
    before = F.lag("day").over(Window.partitionBy("side", "code").orderBy("day"))
    sizes = legs.withColumn("stays", (before == F.col("day") - 1).cast("int")).groupBy("side", "day", "date").agg(F.sum("stays").alias("both"), F.count("*").alias("k"))
    sizes = sizes.withColumn("k0", F.lag("k").over(Window.partitionBy("side").orderBy("day")))
    both = F.coalesce("both", F.lit(0))
    turnover = sizes.filter("k0 IS NOT NULL").groupBy("date").agg(F.avg(1 - both / (F.col("k") + F.col("k0") - both)).alias("turnover"))
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = day.withColumn("r", F.col("up") - F.col("down")).withColumn("l", F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-9)))).over(order)).withColumn("top", F.greatest(F.lit(0.0), F.max("l").over(order)))
    return curve.join(turnover, "date", "left").select("date", rounded(F.col("r"), 6).alias("r"), rounded(F.col("l"), 6).alias("log_nav"), rounded(F.exp(F.col("l") - F.col("top")) - 1, 6).alias("drawdown"), rounded(F.col("turnover"), 6).alias("turnover"), "n")


def strategy_report(curve: DataFrame) -> DataFrame:
    """One row of a curve (date, r, log_nav, drawdown, turnover): years' worth from the mean gap between dates (at most 252 periods a year),
    annual return and deviation, Sharpe, deepest fall, mean turnover, share of gains. NULLs under two rows."""
    g = curve.agg(F.count("*").alias("periods"), F.min("date").alias("a"), F.max("date").alias("z"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("turnover"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"))
    gap = F.try_divide(F.datediff("z", "a"), F.col("periods") - 1)
    year = F.least(F.lit(252.0), F.try_divide(F.lit(365.25), gap))
    return g.select("periods", rounded(year, 4).alias("per_year"), rounded(F.col("m") * year, 5).alias("annual"), rounded(F.col("s") * F.sqrt(year), 5).alias("volatility"), rounded(F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * F.sqrt(year)), 5).alias("sharpe"), "max_drawdown", rounded(F.col("turnover"), 6).alias("turnover"), rounded(F.col("win_rate"), 6).alias("win_rate"))


def smallest(snapshots: DataFrame, wanted: DataFrame, size: int = 400, least: int = 400) -> DataFrame:
    """(date, code, weight): for each wanted date the ``size`` smallest caps of the latest snapshot (date, code, cap) up to it, equal weights;
    nothing for a date whose snapshot has fewer than ``least`` codes with a cap above 0, or that lies before the first."""
    marks = snapshots.select("date").distinct().select("date", F.col("date").alias("snap")).unionByName(wanted.select("date").distinct().withColumn("snap", F.lit(None).cast("date")))
    marks = marks.groupBy("date").agg(F.max("snap").alias("snap"))
    asof = marks.select("date", F.last("snap", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("snap"))
    days = F.broadcast(asof.join(wanted.select("date").distinct(), "date"))
    snap = Window.partitionBy("date")
    own = snapshots.filter("cap > 0").select(F.col("date").alias("snap"), "code", "cap").join(days, "snap").withColumns({"k": F.row_number().over(snap.orderBy("cap", "code")), "n": F.count("*").over(snap)})
    own = own.filter((F.col("n") >= least) & (F.col("k") <= size))
    return own.select("date", "code", rounded(1.0 / F.least("n", F.lit(size)), 6).alias("weight"))


def dividend_pool(yields: DataFrame, reports: DataFrame, size: int = 20, least: int = 15, roe: float = 0.05, most: float = 0.15, growth: float = 0.20) -> DataFrame:
    """(date, symbol, place, weight): the highest dividend yields among symbols whose last report has enough return on equity and
    profit, and growth not above ``growth``; yields of 0 or less and above ``most`` don't count. Nothing for a date with fewer than ``least``."""
    fit = reports.filter((F.col("roe") > roe) & (F.col("profit") > 0) & ~F.coalesce(F.col("growth") > growth, F.lit(False))).select("symbol")
    own = yields.filter((F.col("yield") > 0) & (F.col("yield") <= most)).join(fit, "symbol")
    own = own.withColumns({"place": F.row_number().over(_date().orderBy(F.desc("yield"), "symbol")), "n": F.count("*").over(_date())}).filter((F.col("n") >= least) & (F.col("place") <= size))
    return own.select("date", "symbol", F.col("place").cast("long").alias("place"), rounded(1.0 / F.least("n", F.lit(size)), 6).alias("weight"))


def liquid_pool(day: DataFrame, least: float, special: Sequence[str], size: int) -> DataFrame:
    """(date, code, amount): codes with enough turnover or on the list, each once, the largest ``size`` of a date."""
    own = day.filter((F.col("amount") >= least) | F.col("code").isin(list(special))).groupBy("date", "code").agg(F.max("amount").alias("amount"))
    return own.withColumn("k", F.row_number().over(_date().orderBy(F.desc("amount"), "code"))).filter(F.col("k") <= size).drop("k")


def sector_capped(day: DataFrame, cap: int, size: int) -> DataFrame:
    """(date, code) in order of amount, at most ``cap`` a sector and ``size`` in all."""
    own = day.withColumn("own", F.row_number().over(Window.partitionBy("date", "sector").orderBy(F.desc("amount"), "code"))).filter(F.col("own") <= cap)
    return own.withColumn("k", F.row_number().over(_date().orderBy(F.desc("amount"), "code"))).filter(F.col("k") <= size).select("date", "code")


def revert_signals(rows: DataFrame) -> DataFrame:
    """(code, signal, reason, score) of the last row of each code (rsi, close, lower, upper): oversold, below the band, overbought, above it, in this order."""
    last = rows.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).filter("k = 1")
    ladder = ((F.col("rsi") < 30, "BUY", "oversold", 100 - F.col("rsi")), (F.col("close") < F.col("lower"), "BUY", "below band", F.lit(80.0)), (F.col("rsi") > 70, "SELL", "overbought", F.lit(0.0)), (F.col("close") > F.col("upper"), "SELL", "above band", F.lit(20.0)))

    def pick(at: int, other) -> Column:
        out = None
        for row in ladder:
            value = row[at] if isinstance(row[at], Column) else F.lit(row[at])
            out = F.when(row[0], value) if out is None else out.when(row[0], value)
        return out.otherwise(other)

    return last.select("code", pick(1, F.lit("HOLD")).alias("signal"), pick(2, F.lit("")).alias("reason"), rounded(pick(3, F.lit(50.0)), 4).alias("score"))


def grid_positions(rows: DataFrame, step: float = 0.02) -> DataFrame:
    """(date, code, position, next_buy, next_sell, in_range): how much to hold of each, all at the low of its range (lo, hi) so far and nothing at the high."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo"))))
    return rows.select("date", "code", rounded(1 - at, 6).alias("position"), rounded(F.col("close") * (1 - step), 2).alias("next_buy"), rounded(F.col("close") * (1 + step), 2).alias("next_sell"), F.col("close").between(F.col("lo"), F.col("hi")).alias("in_range"))


def concentration(weights: DataFrame) -> DataFrame:
    """(date, hhi, top5, sectors) of holdings (date, code, sector, weight): the sum of squares, the five largest, and a map of sector weights."""
    own = weights.withColumn("k", F.row_number().over(_date().orderBy(F.desc("weight"), "code")))
    days = own.groupBy("date").agg(rounded(F.sum(F.col("weight") * F.col("weight")), 6).alias("hhi"), rounded(F.sum(F.when(F.col("k") <= 5, F.col("weight"))), 6).alias("top5"))
    groups = weights.groupBy("date", "sector").agg(rounded(F.sum("weight"), 6).alias("w")).groupBy("date").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "sector", F.format_number("w", 4)))), ",").alias("sectors"))
    return days.join(groups, "date")
