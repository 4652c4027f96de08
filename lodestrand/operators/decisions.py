"""Decisions on evidence: red flags, gates, statuses, comparison with truth, thresholds, lifecycle.

Each works on a frame with a row a factor (or run), so many are judged at once and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.panel_ops import average_rank, pair_corr
from lodestrand.operators import evaluation as ev
from lodestrand.plans.layers import rounded


def evidence(long: DataFrame, sectors: DataFrame, cost: float = 0.005) -> DataFrame:
    """A row a factor with what gates and flags look at: days, ic_mean, icir, t, p, coverage, turnover, monotonicity, drawdown
    (of top less bottom bucket), kept (IC out of sample over that in sample), decay, neutral (IC kept within sectors), survives
    (the legs pay their turnover at ``cost``), segments (thirds of the time in which the legs pay in the IC's direction)."""
    ic = ev.daily_ic(long, 5).filter("ic IS NOT NULL")
    tests = ev.ic_tests(ic).withColumn("icir", F.try_divide("ic_mean", "ic_std"))
    covered = long.groupBy("factor").agg((F.count("value") / F.count("*")).alias("coverage"))
    moves = ev.basket_turnover_raw(ev.baskets(long)).groupBy("factor").agg(F.avg("turnover").alias("turnover"))
    buckets = ev.bucketed(long)
    means = buckets.groupBy("date", "factor", "bucket").agg(F.avg("fwd").alias("r")).groupBy("factor", "bucket").agg(F.avg("r").alias("m"))
    means = means.select("factor", F.col("bucket").cast("double").alias("bucket"), F.rank().over(Window.partitionBy("factor").orderBy("m")).cast("double").alias("place"))
    steady = means.groupBy("factor").agg(pair_corr(F.col("bucket"), F.col("place")).alias("monotonicity"))
    legs = ev.leg_returns(buckets)
    order = Window.partitionBy("factor").orderBy("date")
    walk = legs.withColumn("l", F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-9)))).over(order)).withColumn("top", F.greatest(F.lit(0.0), F.max("l").over(order)))
    walk = walk.withColumn("third", F.ntile(3).over(order))
    paid = walk.groupBy("factor").agg(F.min(F.exp(F.col("l") - F.col("top")) - 1).alias("drawdown"), F.avg("r").alias("paid"))
    thirds = walk.groupBy("factor", "third").agg(F.avg("r").alias("m")).groupBy("factor").agg(F.sum((F.col("m") > 0).cast("int")).alias("good"))
    halves = ev.split_by_date(ic).groupBy("factor").pivot("split", ["in", "out"]).agg(F.avg("ic"))
    neutral = ev.sector_means(long, sectors)
    out = tests.join(covered, "factor").join(moves, "factor", "left").join(steady, "factor", "left").join(paid, "factor", "left").join(thirds, "factor", "left").join(halves, "factor", "left").join(neutral, "factor", "left")
    there = F.abs("in") > 1e-10
    return out.select(
        "factor", "days", "ic_mean", "icir", "t", "p", "coverage", "turnover", "monotonicity", "drawdown", F.when(there, F.col("out") / F.col("in")).alias("kept"), F.when(there, (F.col("out") - F.col("in")) / F.abs("in")).alias("decay"),
        F.when(F.abs("before") > 1e-10, F.col("after") / F.col("before")).alias("neutral"), (F.signum("ic_mean") * F.col("paid") > cost * F.col("turnover")).alias("survives"),
        F.when(F.col("ic_mean") < 0, 3 - F.col("good")).otherwise(F.col("good")).cast("int").alias("segments"),
    )


def _or0(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def red_flags(evidence: DataFrame) -> DataFrame:
    """(factor, eight flags, severity): reject below 30 % coverage, else warn if any other flag is up."""
    flags = {
        "low_coverage": F.col("coverage") < 0.3, "few_days": F.col("days") < 120, "weak_ic": F.abs(_or0("ic_mean")) < 0.01, "weak_t": F.abs(_or0("t")) < 1.65,
        "likely_null": F.col("p") > 0.8, "high_turnover": _or0("turnover") > 0.6, "not_monotone": F.abs(_or0("monotonicity")) < 0.5, "deep_drawdown": _or0("drawdown") < -0.3,
    }
    any_of = F.lit(False)
    for c in list(flags.values())[1:]:
        any_of = any_of | c
    return evidence.select("factor", *[c.alias(k) for k, c in flags.items()], F.when(flags["low_coverage"], "reject").when(any_of, "warn").otherwise("ok").alias("severity"))


def validation_gates(evidence: DataFrame, share: float = 0.5) -> DataFrame:
    """(factor, seven gates, applicable, passed_gates, passed). A gate without its data is NULL and doesn't count; a factor
    passes with at least ``share`` of the gates that apply."""
    gates = {
        "oos_retention": (_or0("kept") > 0, F.col("kept") >= 0.7), "ic_significance": (F.lit(True), F.abs(_or0("ic_mean")) >= 0.02), "ic_ir": (F.lit(True), F.abs(_or0("icir")) >= 0.3),
        "time_decay": (F.abs(_or0("decay")) > 0.001, F.abs("decay") <= 0.2), "cost_resilience": (F.col("survives").isNotNull(), F.col("survives")),
        "sector_neutrality": (F.col("neutral").isNotNull(), F.col("neutral") >= 0.5), "segment_consistency": (F.col("segments").isNotNull(), F.col("segments") >= 2),
    }
    told = evidence.select("factor", *[F.when(applies, ok).alias(k) for k, (applies, ok) in gates.items()])
    applicable = sum((F.col(k).isNotNull().cast("int") for k in gates), F.lit(0))
    passed = sum((F.coalesce(F.col(k), F.lit(False)).cast("int") for k in gates), F.lit(0))
    return told.select("*", applicable.alias("applicable"), passed.alias("passed_gates"), (passed >= share * applicable).alias("passed"))


def evaluation_status(evidence: DataFrame, ic: float = 0.02, icir: float = 0.3, turnover: float = 0.7, kept: float = 0.3) -> DataFrame:
    """(factor, weak_ic, noisy, costly, sector_bet, status): a warning makes "warn"; "fail" takes two failures, of which a weak IC is one."""
    told = evidence.select("factor", (F.abs(_or0("ic_mean")) < ic).alias("weak_ic"), (_or0("icir") < icir).alias("noisy"), (_or0("turnover") > turnover).alias("costly"), (_or0("neutral") < kept).alias("sector_bet"))
    return told.withColumn("status", F.when(F.col("weak_ic") | F.col("noisy") | F.col("costly") | F.col("sector_bet"), "warn").otherwise("pass"))


def confidence(evidence: DataFrame) -> DataFrame:
    """(factor, score, verdict) of five parts (25, 25, 20, 15, 15); ``alike`` is the likeness to the most alike other factor."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = F.when(F.col("p") < 0.05, 25.0).otherwise(0.0) + 25 * unit(_or0("kept")) + 20 * unit(1 - F.coalesce("turnover", F.lit(1.0))) + 15 * unit(F.col("coverage")) + 15 * unit(1 - _or0("alike"))
    score = rounded(score, 4)
    return evidence.select("factor", score.alias("score"), F.when(score >= 70, "SAFE").when(score >= 40, "REVIEW").otherwise("REJECT").alias("verdict"))


def daily_truth_corr(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(date, spearman, pearson) of submitted and truth on dates with ``least`` pairs or more."""
    own = pairs.filter("truth IS NOT NULL AND submitted IS NOT NULL").withColumns({"a": average_rank(F.col("submitted"), ["date"]), "b": average_rank(F.col("truth"), ["date"])})
    days = own.groupBy("date").agg(pair_corr(F.col("a"), F.col("b")).alias("spearman"), pair_corr(F.col("submitted"), F.col("truth")).alias("pearson"), F.count("*").alias("n"))
    return days.filter(F.col("n") >= least).drop("n")


def truth_metrics(pairs: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """One row: n, overlap, exact, max_error, mean_error, mean_spearman, mean_pearson."""
    gap = F.abs(F.col("submitted") - F.col("truth"))
    whole = pairs.agg(F.count("*").alias("n"), F.count(gap).alias("overlap"), F.count(F.when(gap <= tolerance, 1)).alias("exact"), rounded(F.max(gap), 6).alias("max_error"), rounded(F.avg(gap), 6).alias("mean_error"))
    daily = daily_truth_corr(pairs).agg(rounded(F.avg("spearman"), 6).alias("mean_spearman"), rounded(F.avg("pearson"), 6).alias("mean_pearson"))
    return whole.join(F.broadcast(daily))


def truth_status(pairs: DataFrame) -> DataFrame:
    """One row: status by how much overlaps (0.9), how much of that is exact (0.99, 0.9) and the worst error."""
    gap = F.abs(F.col("submitted") - F.col("truth"))
    m = pairs.agg(rounded(F.try_divide(F.count(gap), F.count("submitted")), 6).alias("overlap"), rounded(F.try_divide(F.count(F.when(gap <= 1e-8, 1)), F.count(gap)), 6).alias("exact"), F.max(gap).alias("worst"))
    status = F.when(F.coalesce("overlap", F.lit(0.0)) < 0.9, "not_compared").when((F.col("exact") >= 0.99) & (F.col("worst") <= 1e-8), "passed").when(F.col("exact") >= 0.9, "partial").otherwise("failed")
    return m.select(status.alias("status"), "overlap", "exact")


def truth_quality(frame: DataFrame) -> DataFrame:
    """One row: n, filled, coverage, duplicate_rows (all rows of a key that isn't alone) and whether there is no value at all."""
    keys = frame.groupBy("date", "code").agg(F.count("*").alias("k"), F.count("truth").alias("filled"))
    return keys.agg(F.sum("k").alias("n"), F.sum("filled").alias("filled"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("duplicate_rows")).select(
        "n", "filled", rounded(F.try_divide("filled", "n"), 6).alias("coverage"), "duplicate_rows", (F.col("filled") == 0).alias("is_empty")
    )


_COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}


def meets(value: Column, rule: str) -> Column:
    """Whether a value meets a threshold such as ">= 0.02"; NULL where the value is missing."""
    for sign in (">=", "<=", "==", ">", "<"):
        if rule.strip().startswith(sign):
            return _COMPARE[sign](value, F.lit(float(rule.strip()[len(sign) :])))
    raise ValueError(f"no comparison in {rule!r}")


def threshold_report(metrics: DataFrame, rules: Mapping[str, str], key: str = "factor") -> DataFrame:
    """(key, metric, value, rule, status) for every rule; a missing value is pending."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(rule).alias("rule"), meets(F.col(m), rule).alias("ok")) for m, rule in rules.items()])
    told = metrics.select(key, F.explode(each).alias("x"))
    return told.select(key, "x.metric", "x.value", "x.rule", F.when(F.col("x.ok").isNull(), "pending").when(F.col("x.ok"), "passed").otherwise("failed").alias("status"))


def overall(report: DataFrame, key: str = "factor") -> DataFrame:
    """(key, status, failed, pending, passed): failed if any check is, else pending or partial if any is, else passed."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    n = report.groupBy(key).agg(count("failed").alias("failed"), count("pending").alias("pending"), count("passed").alias("passed"))
    status = F.when(F.col("failed") > 0, "failed").when((F.col("pending") > 0) & (F.col("passed") > 0), "partial").when(F.col("pending") > 0, "pending").otherwise("passed")
    return n.select(key, status.alias("status"), "failed", "pending", "passed")
