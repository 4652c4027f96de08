"""Evaluation of factors, over long frames (date, code, factor, value, fwd): information coefficients, buckets,
turnover, comparison with truth. Missing is NULL; a correlation of a side that doesn't move is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.panel_ops import average_rank, pair_corr
from lodestrand.plans.layers import rounded

# ln(erfc(x) / u) + x * x as a polynomial in u = 1 / (1 + x / 2), lowest power first, fitted for x from 0 to 26.5.
ERFC = (
    -1.265512118279419, 0.9999996346976705, 0.37501139121692106, 0.08312371242864794, -0.08338712782986187, -0.1655253423175153, 0.04322410907878502, -0.5899392095583587, 2.2493276876315407, -5.2194203849570355,
    9.630581014475002, -11.689119737893659, 6.140841003941358, 4.475583511648242, -11.004694509072237, 9.509568485057727, -4.555366022055631, 1.2038569764025668, -0.13815307461513568,
)


def long_form(frame: DataFrame, factors: Sequence[str], fwd: str = "fwd") -> DataFrame:
    """(date, code, factor, value, fwd) of a wide frame, one row a factor."""
    return frame.unpivot(["date", "code", fwd], list(factors), "factor", "value").select("date", "code", "factor", "value", F.col(fwd).alias("fwd"))


def complete(long: DataFrame) -> DataFrame:
    return long.filter("value IS NOT NULL AND fwd IS NOT NULL")


def daily_ic(long: DataFrame, least: int = 1, by: Sequence[str] = ("date", "factor")) -> DataFrame:
    """(date, factor, ic, pearson, n): rank and plain correlation of values and later returns over the complete pairs
    of each date, dates with ``least`` pairs or more."""
    by = list(by)
    ranked = complete(long).withColumns({"rv": average_rank(F.col("value"), by), "rf": average_rank(F.col("fwd"), by)})
    found = ranked.groupBy(*by).agg(rounded(pair_corr(F.col("rv"), F.col("rf")), 6).alias("ic"), rounded(pair_corr(F.col("value"), F.col("fwd")), 6).alias("pearson"), F.count("*").alias("n"))
    return found.filter(F.col("n") >= least)


def two_sided(t: Column) -> Column:
    """erfc(abs(t) / sqrt 2), to 1e-12 of its size; 1 for a missing t."""
    x = F.least(F.abs(t) / 2**0.5, F.lit(26.0))
    u = 1 / (1 + x / 2)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = power * u + F.lit(c)
    return F.when(t.isNull(), 1.0).otherwise(F.least(F.lit(1.0), u * F.exp(power - x * x)))


def ic_tests(ic: DataFrame) -> DataFrame:
    """(factor, days, ic_mean, ic_std, t, p) of the daily IC of each factor."""
    stats = ic.groupBy("factor").agg(F.count("*").alias("days"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"))
    stats = stats.withColumn("t", F.try_divide("ic_mean", F.col("ic_std") / F.sqrt("days")))
    return stats.withColumn("p", two_sided(F.col("t")))


def ic_summary(ic: DataFrame, keys: Sequence[str] = ("factor",), population: bool = False) -> DataFrame:
    std = F.stddev_pop("ic") if population else F.stddev_samp("ic")
    return ic.groupBy(*keys).agg(
        F.count("*").alias("n"), rounded(F.avg("ic"), 6).alias("ic_mean"), rounded(std, 6).alias("ic_std"), rounded(F.try_divide(F.avg("ic"), std), 6).alias("icir"),
        rounded(F.avg((F.col("ic") > 0).cast("double")), 6).alias("win_rate"), F.max("ic").alias("ic_max"), F.min("ic").alias("ic_min"), rounded(F.try_divide(F.avg("ic"), std / F.sqrt(F.count("*"))), 5).alias("t_stat"),
    )


def corrected(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """(factor, p_value, q_value, bonferroni, significant): Benjamini-Hochberg and Bonferroni. ``tests`` has a row a factor, so
    the one order over all of them is of a bounded number of rows."""
    order = Window.orderBy("p", "factor")
    placed = tests.select("factor", "p", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy()).alias("m"))
    q = F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("k")).over(Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)))
    return placed.withColumn("q", q).select("factor", rounded(F.col("p"), 8).alias("p_value"), rounded(F.col("q"), 6).alias("q_value"), rounded(F.least(F.lit(1.0), F.col("p") * F.col("m")), 6).alias("bonferroni"), (F.col("q") < level).alias("significant"))


def ic_trend(ic: DataFrame, least: int = 60) -> DataFrame:
    """A straight line through each factor's daily IC: slope, start, r2, p of the slope, means of both halves, days until the IC is
    halved (NULL unless it falls), and whether it decays. Factors of fewer than ``least`` days are left out."""
    own = Window.partitionBy("factor")
    rows = ic.select("factor", "ic", (F.row_number().over(own.orderBy("date")) - 1).cast("double").alias("day"), F.count("*").over(own).alias("days")).filter(F.col("days") >= least)
    half = F.floor(F.col("days") / 2)
    fit = rows.groupBy("factor").agg(
        F.max("days").alias("n"), F.regr_slope("ic", "day").alias("slope"), F.regr_intercept("ic", "day").alias("start"), F.regr_r2("ic", "day").alias("r2"),
        F.avg(F.when(F.col("day") < half, F.col("ic"))).alias("first_half"), F.avg(F.when(F.col("day") >= half, F.col("ic"))).alias("second_half"),
    )
    t = F.signum("slope") * F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    falls = F.col("slope") < 0
    return fit.withColumn("p", two_sided(t)).select(
        "factor", "n", rounded(F.col("slope"), 8).alias("slope"), rounded(F.col("start"), 6).alias("start"), rounded(F.col("r2"), 6).alias("r2"), rounded(F.col("p"), 6).alias("p_value"), rounded(F.col("first_half"), 6).alias("first_half"),
        rounded(F.col("second_half"), 6).alias("second_half"), rounded(F.when(falls & (F.abs("first_half") > 1e-10), F.abs(F.col("first_half") / 2 / F.col("slope"))), 1).alias("half_life"), (falls & (F.col("p") < 0.05)).alias("decays"),
    )


def split_by_date(ic: DataFrame, share: float = 0.7) -> DataFrame:
    """``ic`` with a column split: "in" for the first ``share`` of all its dates, "out" for the rest."""
    days = ic.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("k"), F.count("*").over(Window.partitionBy()).alias("m"))
    days = days.select("date", F.when(F.col("k") < F.floor(F.col("m") * share), "in").otherwise("out").alias("split"))
    return ic.join(F.broadcast(days), "date")


def out_of_sample(ic: DataFrame, share: float = 0.7) -> DataFrame:
    """(factor, in_mean, out_mean, kept, in_p, overfit): how much of the IC stays after the split; overfit if less than
    half does and the IC before was significant."""
    each = split_by_date(ic, share).groupBy("factor").pivot("split", ["in", "out"]).agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.count("ic").alias("n"))
    kept = F.when(F.abs("in_mean") > 1e-10, F.col("out_mean") / F.col("in_mean"))
    p = two_sided(F.try_divide("in_mean", F.col("in_std") / F.sqrt("in_n")))
    return each.select("factor", rounded(F.col("in_mean"), 6).alias("in_mean"), rounded(F.col("out_mean"), 6).alias("out_mean"), rounded(kept, 4).alias("kept"), rounded(p, 6).alias("in_p"), F.coalesce((kept < 0.5) & (p < 0.05), F.lit(False)).alias("overfit"))


def bucketed(long: DataFrame, buckets: int = 5) -> DataFrame:
    """Complete pairs with a bucket, 1 .. ``buckets``, by ranks that ties never share (by code)."""
    group = Window.partitionBy("date", "factor")
    k, n = F.row_number().over(group.orderBy("value", "code")), F.count("*").over(group)
    bucket = F.when(F.col("n") == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("k") - 1) * float(buckets) / F.nullif(F.col("n") - 1, F.lit(0))))).cast("int")
    return complete(long).withColumns({"k": k, "n": n}).withColumn("bucket", bucket).drop("k", "n")


def value_buckets(long: DataFrame, buckets: int = 5) -> DataFrame:
    """(date, code, factor, bucket) by linear quantiles of the values of a date; edges that fall together are one, so there
    can be fewer buckets. The lowest value belongs to the first bucket."""
    edges = [F.percentile("value", F.lit(k / buckets)).alias(f"e{k}") for k in range(buckets + 1)]
    cuts = long.filter("value IS NOT NULL").groupBy("date", "factor").agg(*edges)
    cuts = cuts.select("date", "factor", F.array_distinct(F.array(*[f"e{k}" for k in range(buckets + 1)])).alias("edges"))
    own = long.filter("value IS NOT NULL").join(cuts, ["date", "factor"])
    below = F.size(F.filter("edges", lambda e: e < F.col("value")))
    return own.select("date", "code", "factor", F.when(F.size("edges") > 1, F.greatest(below, F.lit(1))).cast("int").alias("bucket"))


def leg_returns(buckets: DataFrame, top: int = 5) -> DataFrame:
    """(date, factor, r): mean return of the top bucket less that of the bottom one."""
    hi, lo = (F.when(F.col("bucket") == b, F.col("fwd")) for b in (top, 1))
    return buckets.groupBy("date", "factor").agg(rounded(F.avg(hi) - F.avg(lo), 8).alias("r")).filter("r IS NOT NULL")


def numbered_days(frame: DataFrame) -> DataFrame:
    """(date, day) of all dates in a frame; one row a date, so one task can number them."""
    return frame.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).cast("long").alias("day"))


def baskets(long: DataFrame, share: float = 0.2) -> DataFrame:
    """(factor, day, date, code) of the codes in the top ``share`` of each date."""
    group = Window.partitionBy("factor", "date")
    ranked = long.filter("value IS NOT NULL").withColumns({"k": F.rank().over(group.orderBy(F.desc("value"))), "n": F.count("*").over(group)})
    return ranked.filter(F.col("k") <= share * F.col("n")).join(F.broadcast(numbered_days(long)), "date").select("factor", "day", "date", "code")


def basket_turnover(basket: DataFrame) -> DataFrame:
    """(factor, date, turnover, jaccard): what share of the basket of the day before is gone, and of both baskets together isn't in both."""
    return basket_turnover_raw(basket).select("factor", "date", rounded(F.col("turnover"), 6).alias("turnover"), rounded(F.col("jaccard"), 6).alias("jaccard"))


def basket_turnover_raw(basket: DataFrame) -> DataFrame:
    """As :func:`basket_turnover`, not rounded. Whether a code was there the day before is told by its last day in the basket: no self join."""
    before = F.lag("day").over(Window.partitionBy("factor", "code").orderBy("day"))
    days = basket.withColumn("stays", (before == F.col("day") - 1).cast("int")).groupBy("factor", "date", "day").agg(F.sum("stays").alias("both"), F.count("*").alias("n"))
    order = Window.partitionBy("factor").orderBy("day")
    days = days.withColumns({"earlier": F.lag("n").over(order), "last": F.lag("day").over(order)}).filter("last = day - 1")
    both = F.coalesce("both", F.lit(0))
    return days.select("factor", "date", (1 - both / F.col("earlier")).alias("turnover"), (1 - both / (F.col("n") + F.col("earlier") - both)).alias("jaccard"))


def rank_turnover(long: DataFrame) -> DataFrame:
    """(factor, day, turnover, rank_change): one less the correlation of ranks with those of the day before, and the mean change of the percent rank, of codes there on both."""
    by = ["factor", "day"]
    ranked = long.filter("value IS NOT NULL").join(F.broadcast(numbered_days(long)), "date").withColumns({"r": average_rank(F.col("value"), by), "n": F.count("*").over(Window.partitionBy(*by))})
    own = Window.partitionBy("factor", "code").orderBy("day")
    ranked = ranked.withColumns({"last": F.lag("day").over(own), "r0": F.lag("r").over(own), "n0": F.lag("n").over(own)}).filter("last = day - 1")
    found = ranked.groupBy(*by).agg(pair_corr(F.col("r"), F.col("r0")).alias("c"), F.avg(F.abs(F.col("r") / F.col("n") - F.col("r0") / F.col("n0"))).alias("change"), F.count("*").alias("n"))
    return found.filter("n >= 3").select("factor", "day", rounded(1 - F.col("c"), 6).alias("turnover"), rounded(F.col("change"), 6).alias("rank_change"))


def monotonicity(buckets: DataFrame) -> DataFrame:
    """(factor, monotonicity): rank correlation of buckets with their mean returns over dates."""
    means = buckets.groupBy("date", "factor", "bucket").agg(F.avg("fwd").alias("r")).groupBy("factor", "bucket").agg(F.avg("r").alias("m"))
    means = means.select("factor", F.col("bucket").cast("double").alias("bucket"), F.rank().over(Window.partitionBy("factor").orderBy("m")).cast("double").alias("place"))
    return means.groupBy("factor").agg(rounded(pair_corr(F.col("bucket"), F.col("place")), 6).alias("monotonicity"))


def coverage(long: DataFrame) -> DataFrame:
    """(factor, n, coverage): values that are there, and their share of all dates times codes."""
    found = long.groupBy("factor").agg(F.count("value").alias("n"), F.count_distinct("code").alias("codes"), F.count_distinct("date").alias("dates"))
    return found.select("factor", "n", rounded(F.col("n") / (F.col("codes") * F.col("dates")), 6).alias("coverage"))


def pair_columns(frame: DataFrame, factors: Sequence[str], by: Sequence[str], value, ordered: bool = True) -> DataFrame:
    """(by..., a, b, value) of all pairs of factors of a wide frame, in one aggregate over it; ``value`` takes two columns."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    wide = frame.groupBy(*by).agg(*[value(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("value")) for a, b in pairs])
    return wide.select(*by, F.explode(each).alias("p")).select(*by, "p.a", "p.b", "p.value")


def similarity(frame: DataFrame, factors: Sequence[str], least: int = 10) -> DataFrame:
    """(a, b, n, corr, corr_std): mean over dates of the rank correlation of two factors, dates with ``least`` pairs or more."""
    ranked = frame.select("date", *[average_rank(F.col(f), ["date"]).alias(f) for f in factors])
    both = lambda a, b: F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    daily = pair_columns(ranked, factors, ["date"], lambda a, b: F.when(both(a, b) >= least, pair_corr(a, b))).filter("value IS NOT NULL")
    return daily.groupBy("a", "b").agg(F.count("*").alias("n"), rounded(F.avg("value"), 6).alias("corr"), rounded(F.stddev_pop("value"), 6).alias("corr_std"))


def mirrored(pairs: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(factor, one column a factor): a symmetric matrix of (a, b, corr), 1 on the diagonal."""
    ones = pairs.sparkSession.createDataFrame([(f, f, 1.0) for f in factors], "a string, b string, corr double")
    every = pairs.select("a", "b", "corr").union(pairs.select("b", "a", "corr")).union(ones)
    return every.groupBy(F.col("a").alias("factor")).pivot("b", list(factors)).agg(F.max("corr"))


def sector_means(long: DataFrame, sectors: DataFrame, least: int = 5) -> DataFrame:
    """(factor, before, after, r2): mean IC of the values, mean IC of what is left of them without their sector's mean of
    the date, and the mean share of variance between sectors. Rows without a sector are a sector of their own."""
    own = complete(long).join(sectors.select("date", "code", F.coalesce("sector", F.lit("")).alias("sector")), ["date", "code"])
    own = own.withColumn("inside", F.avg("value").over(Window.partitionBy("date", "factor", "sector"))).withColumn("mean", F.avg("value").over(Window.partitionBy("date", "factor")))
    days = own.groupBy("date", "factor").agg(
        pair_corr(F.col("value"), F.col("fwd")).alias("before"), pair_corr(F.col("value") - F.col("inside"), F.col("fwd")).alias("after"), F.count("*").alias("n"),
        F.sum(F.pow(F.col("inside") - F.col("mean"), 2)).alias("between"), F.sum(F.pow(F.col("value") - F.col("mean"), 2)).alias("total"),
    ).filter(F.col("n") >= least)
    return days.groupBy("factor").agg(F.avg("before").alias("before"), F.avg("after").alias("after"), F.avg(F.when(F.col("total") > 1e-12, F.col("between") / F.col("total"))).alias("r2"))


def sector_neutral(long: DataFrame, sectors: DataFrame) -> DataFrame:
    """(factor, ic_before, ic_after, kept, r2) of :func:`sector_means`; kept is the share of the IC that stays."""
    found = sector_means(long, sectors)
    return found.select("factor", rounded(F.col("before"), 6).alias("ic_before"), rounded(F.col("after"), 6).alias("ic_after"), rounded(F.when(F.abs("before") > 1e-10, F.col("after") / F.col("before")), 6).alias("kept"), rounded(F.col("r2"), 6).alias("r2"))
