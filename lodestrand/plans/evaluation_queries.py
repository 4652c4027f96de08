"""Queries of factor evaluation on the panel of brands by week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrand.functions.panel_ops import average_rank, pair_corr
from lodestrand.operators import decisions, inference
from lodestrand.operators import evaluation as ev
from lodestrand.plans.layers import compute, rounded
from lodestrand.plans.oracles.frames import FACTORS, HORIZONS, corr, place, query, r
from lodestrand.plans.registry import Registry
from lodestrand.sources.panel import brand_week

QUERIES = Registry()

FORMULAS = {"mom": "RET(close, 4)", "rev": "-1 * RET(close, 1)", "liq": "volume / MEAN(volume, 4) - 1", "rng": "MEAN((high - low) / close, 4)", "fwd": "DELAY(close, -1) / close - 1"}


def factors(spark: SparkSession, d: str) -> DataFrame:
    return compute(brand_week(spark, d), FORMULAS, 6)


def long(spark: SparkSession, d: str) -> DataFrame:
    return ev.long_form(factors(spark, d), FACTORS)


def ic5(spark: SparkSession, d: str) -> DataFrame:
    return ev.daily_ic(long(spark, d), 5).filter("ic IS NOT NULL")


_SUMMARY = f"""count(*) AS n, {r('avg(ic)')} AS ic_mean, {r('stddev_samp(ic)')} AS ic_std, {r('(avg(ic) / nullif(stddev_samp(ic), 0))')} AS icir,
  {r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, max(ic) AS ic_max, min(ic) AS ic_min, {r('(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0))', 5)} AS t_stat"""


@QUERIES.add(query("SELECT date, factor, ic, pearson, n FROM ic WHERE ic IS NOT NULL", "ic"))
def ic_daily(s, d):
    return ev.daily_ic(long(s, d)).filter("ic IS NOT NULL")


@QUERIES.add(query("SELECT date, factor, ic, n FROM ic WHERE n >= 3 AND ic IS NOT NULL", "ic"))
def ic_daily_min3(s, d):
    return ev.daily_ic(long(s, d), 3).filter("ic IS NOT NULL").drop("pearson")


@QUERIES.add(query("SELECT date, factor, ic, n FROM ic WHERE n >= 10", "ic"))
def ic_long(s, d):
    return ev.daily_ic(long(s, d), 10).drop("pearson")


@QUERIES.add(query(f"SELECT factor, {_SUMMARY} FROM ic5 GROUP BY factor", "ic5"))
def ic_summary(s, d):
    return ev.ic_summary(ic5(s, d))


@QUERIES.add(query(f"SELECT factor, {r('avg(ic)')} AS ic_mean, {r('(avg(ic) / nullif(stddev_pop(ic), 0))')} AS icir FROM ic5 GROUP BY factor", "ic5"))
def ic_summary_pop(s, d):
    return ev.ic_summary(ic5(s, d), population=True).select("factor", "ic_mean", "icir")


@QUERIES.add(query(f"SELECT factor, CAST(year(date) AS INT) AS year, count(*) AS n, {r('avg(ic)')} AS ic_mean, {r('stddev_samp(ic)')} AS ic_std FROM ic5 GROUP BY factor, year(date)", "ic5"))
def ic_yearly(s, d):
    return ev.ic_summary(ic5(s, d).withColumn("year", F.year("date")), ("factor", "year")).select("factor", "year", "n", "ic_mean", "ic_std")


@QUERIES.add(query(f"SELECT factor, icir, (SELECT count(*) FROM s o WHERE abs(o.icir) > abs(s.icir) OR (abs(o.icir) = abs(s.icir) AND o.factor <= s.factor)) AS place FROM s", "ic5", s=f"SELECT factor, {r('(avg(ic) / nullif(stddev_samp(ic), 0))')} AS icir FROM ic5 GROUP BY factor"))
def ic_rank_table(s, d):
    """A row a factor, so one order over all of them."""
    return ev.ic_summary(ic5(s, d)).select("factor", "icir", F.row_number().over(Window.orderBy(F.desc(F.abs("icir")), "factor")).cast("long").alias("place"))


@QUERIES.add(query("SELECT factor, date, CASE WHEN day(date) % 7 = 0 THEN 0.01 ELSE 0.0 END AS gap, day(date) % 7 <> 0 AS same FROM ic5", "ic5"))
def ic_truth_match(s, d):
    own = ic5(s, d)
    truth = own.select("date", "factor", (F.col("ic") + F.when(F.dayofmonth("date") % 7 == 0, 0.01).otherwise(0.0)).alias("truth"))
    gap = F.round(F.abs(F.col("ic") - F.col("truth")), 6)
    return own.join(truth, ["date", "factor"]).select("factor", "date", gap.alias("gap"), (gap < 1e-4).alias("same"))


def _erfc(t: str) -> str:
    """erfc(abs(t) / sqrt 2) by the continued series of its logarithm; see the operators for the fixed values."""
    x = f"least(abs({t}) / sqrt(2.0), 26.0)"
    terms = " + ".join(f"({c!r}) * pow(1 / (1 + {x} / 2), {k})" for k, c in enumerate(ev.ERFC))
    return f"CASE WHEN {t} IS NULL THEN 1.0 ELSE least(1.0, 1 / (1 + {x} / 2) * exp({terms} - {x} * {x})) END"


_P = {"p": f"SELECT *, {_erfc('t')} AS p FROM tests"}


@QUERIES.add(query(f"SELECT factor, {r('t', 5)} AS t_stat, {r('p', 8)} AS p_value, abs(t) >= 1.65 AS telling FROM p", "tests", **_P))
def ic_tstat(s, d):
    t = ev.ic_tests(ic5(s, d))
    return t.select("factor", rounded(F.col("t"), 5).alias("t_stat"), rounded(F.col("p"), 8).alias("p_value"), (F.abs("t") >= 1.65).alias("telling"))


@QUERIES.add(query(
    f"""SELECT a.factor, {r('a.p', 8)} AS p_value, {r('(SELECT min(least(1.0, b.p * (SELECT count(*) FROM k) / b.k)) FROM k b WHERE b.k >= a.k)')} AS q_value,
      {r('least(1.0, a.p * (SELECT count(*) FROM k))')} AS bonferroni, (SELECT min(b.p * (SELECT count(*) FROM k) / b.k) FROM k b WHERE b.k >= a.k) < 0.05 AS significant FROM k a""",
    "tests", **_P, k="SELECT factor, p, row_number() OVER (ORDER BY p, factor) AS k FROM p"))
def fdr_bh(s, d):
    return ev.corrected(ev.ic_tests(ic5(s, d)))


_TREND_T = "(sign(slope) * sqrt(r2 * (n - 2) / nullif(1 - r2, 0)))"


@QUERIES.add(query(
    f"""SELECT factor, n, {r('slope', 8)} AS slope, {r('start')} AS start, {r('r2')} AS r2, {r(_erfc(_TREND_T))} AS p_value, {r('first_half')} AS first_half, {r('second_half')} AS second_half,
      {r('(CASE WHEN slope < 0 AND abs(first_half) > 1e-10 THEN abs(first_half / 2 / slope) END)', 1)} AS half_life, slope < 0 AND {_erfc(_TREND_T)} < 0.05 AS decays FROM fit WHERE n >= 60""",
    "ic5", days="SELECT factor, ic, CAST(row_number() OVER (PARTITION BY factor ORDER BY date) - 1 AS DOUBLE) AS k, count(*) OVER (PARTITION BY factor) AS m FROM ic5",
    fit="""SELECT factor, count(*) AS n, covar_pop(ic, k) / var_pop(k) AS slope, avg(ic) - covar_pop(ic, k) / var_pop(k) * avg(k) AS start, pow(corr(ic, k), 2) AS r2,
      avg(ic) FILTER (k < m // 2) AS first_half, avg(ic) FILTER (k >= m // 2) AS second_half FROM days GROUP BY factor"""))  # fmt: skip
def ic_trend(s, d):
    return ev.ic_trend(ic5(s, d))


@QUERIES.add(query(f"SELECT a.factor, a.date, {r('avg(b.ic)')} AS ic60 FROM k a JOIN k b ON a.factor = b.factor AND b.k BETWEEN a.k - 59 AND a.k WHERE a.k >= 60 AND (a.k - 60) % 20 = 0 GROUP BY a.factor, a.date", "ic5", k="SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date) AS k FROM ic5"))
def ic_rolling(s, d):
    order = Window.partitionBy("factor").orderBy("date")
    rows = ic5(s, d).select("factor", "date", F.avg("ic").over(order.rowsBetween(-59, 0)).alias("ic60"), F.row_number().over(order).alias("k"))
    return rows.filter("k >= 60 AND (k - 60) % 20 = 0").select("factor", "date", rounded(F.col("ic60"), 6).alias("ic60"))


_SPLIT = {"split": "SELECT date, CASE WHEN row_number() OVER (ORDER BY date) <= floor(count(*) OVER () * 0.7) THEN 'in' ELSE 'out' END AS split FROM (SELECT DISTINCT date FROM ic5)"}


@QUERIES.add(query(f"SELECT factor, split, count(*) AS n, {r('avg(ic)')} AS ic_mean, {r('stddev_samp(ic)')} AS ic_std FROM ic5 JOIN split USING (date) GROUP BY factor, split", "ic5", **_SPLIT))
def oos_split(s, d):
    return ev.ic_summary(ev.split_by_date(ic5(s, d)), ("factor", "split")).select("factor", "split", "n", "ic_mean", "ic_std")


_OOS = {**_SPLIT, "halves": "SELECT factor, avg(ic) FILTER (split = 'in') AS a, avg(ic) FILTER (split = 'out') AS b, avg(ic) FILTER (split = 'in') / nullif(stddev_samp(ic) FILTER (split = 'in') / sqrt(count(*) FILTER (split = 'in')), 0) AS t FROM ic5 JOIN split USING (date) GROUP BY factor"}


@QUERIES.add(query(f"SELECT factor, {r('a')} AS in_mean, {r('b')} AS out_mean, {r('(CASE WHEN abs(a) > 1e-10 THEN b / a END)', 4)} AS kept, {r(_erfc('t'))} AS in_p, coalesce(abs(a) > 1e-10 AND b / a < 0.5 AND {_erfc('t')} < 0.05, false) AS overfit FROM halves", "ic5", **_OOS))
def oos_compare(s, d):
    return ev.out_of_sample(ic5(s, d))


def _decay(returns: DataFrame, columns: dict[str, int], name: str) -> DataFrame:
    own = returns.unpivot(["date", "code", *columns], list(FACTORS), "factor", "value")
    steps = own.unpivot(["date", "code", "factor", "value"], list(columns), "_step", "fwd")
    steps = steps.withColumn(name, F.regexp_extract("_step", r"(\d+)", 1).cast("int"))
    ic = ev.daily_ic(steps, 5, ("date", "factor", name)).filter("ic IS NOT NULL")
    return ev.ic_summary(ic, ("factor", name)).select("factor", name, "n", "ic_mean", "icir", F.col("win_rate").alias("positive_ratio"))


def _decay_sql(frame: str, steps: tuple[int, ...], name: str) -> str:
    ranked = f"SELECT date, factor, h, {place('value', 'date, factor, h')} AS rv, {place('fwd', 'date, factor, h')} AS rf FROM steps WHERE value IS NOT NULL AND fwd IS NOT NULL"
    every = " UNION ALL ".join(f"SELECT date, '{f}' AS factor, {h} AS h, {f} AS value, r{h} AS fwd FROM ahead" for f in FACTORS for h in steps)
    daily = f"SELECT date, factor, h, {r(corr('rv', 'rf'))} AS ic, count(*) AS n FROM ranked GROUP BY date, factor, h"
    out = f"SELECT factor, CAST(h AS INT) AS {name}, count(*) AS n, {r('avg(ic)')} AS ic_mean, {r('(avg(ic) / nullif(stddev_samp(ic), 0))')} AS icir, {r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_ratio FROM daily WHERE n >= 5 AND ic IS NOT NULL GROUP BY factor, h"
    return query(out, "factor", ahead=frame, steps=every, ranked=ranked, daily=daily)


@QUERIES.add(_decay_sql("SELECT f.*, " + ", ".join(r(f"(lead(p.close, {h}) OVER (PARTITION BY p.code ORDER BY p.date) / p.close - 1)") + f" AS r{h}" for h in HORIZONS) + " FROM factor f JOIN panel p USING (date, code)", HORIZONS, "horizon"))
def ic_decay(s, d):
    ahead = {f"r{h}": f"DELAY(close, -{h}) / close - 1" for h in HORIZONS}
    frame = compute(brand_week(s, d), {f: FORMULAS[f] for f in FACTORS} | ahead, 6)
    return _decay(frame, {c: 0 for c in ahead}, "horizon")


@QUERIES.add(_decay_sql("SELECT *, fwd AS r0, " + ", ".join(f"lead(fwd, {h}) OVER (PARTITION BY code ORDER BY date) AS r{h}" for h in HORIZONS) + " FROM factor", (0, *HORIZONS), "lag"))
def ic_decay_later(s, d):
    order = Window.partitionBy("code").orderBy("date")
    frame = factors(s, d).withColumns({"r0": F.col("fwd"), **{f"r{h}": F.lead("fwd", h).over(order) for h in HORIZONS}})
    return _decay(frame, {f"r{h}": 0 for h in (0, *HORIZONS)}, "lag")


# factors among each other

_PAIRS = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]]
_POOLED = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {corr(a, b)} AS c FROM factor" for a, b in _PAIRS)


def _pooled(s, d) -> DataFrame:
    return ev.pair_columns(factors(s, d), FACTORS, [], pair_corr).select("a", "b", F.col("value").alias("c"))


@QUERIES.add(query(f"SELECT a, b, {r('c')} AS corr FROM c", "factor", c=_POOLED))
def factor_corr_matrix(s, d):
    return _pooled(s, d).select("a", "b", rounded(F.col("c"), 6).alias("corr"))


@QUERIES.add(query(f"SELECT a, b, {r('c')} AS corr, abs(c) >= 0.85 AS redundant FROM c", "factor", c=_POOLED))
def redundant_factors(s, d):
    return _pooled(s, d).select("a", "b", rounded(F.col("c"), 6).alias("corr"), (F.abs("c") >= 0.85).alias("redundant"))


@QUERIES.add(query("SELECT factor, other, corr FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY abs(corr) DESC, other) AS k FROM both_ways) WHERE k <= 2", "factor", c=_POOLED, both_ways=f"SELECT a AS factor, b AS other, {r('c')} AS corr FROM c UNION ALL SELECT b, a, {r('c')} FROM c"))
def similar_factors_topk(s, d):
    pairs = _pooled(s, d).select("a", "b", rounded(F.col("c"), 6).alias("corr"))
    both = pairs.select(F.col("a").alias("factor"), F.col("b").alias("other"), "corr").union(pairs.select("b", "a", "corr"))
    return both.withColumn("k", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc(F.abs("corr")), "other"))).filter("k <= 2").drop("k")


_SIMILAR = {
    "placed": "SELECT date, code, factor, value, " + place("value", "date, factor") + " AS rv FROM long WHERE value IS NOT NULL",
    "daily": f"SELECT x.factor AS a, y.factor AS b, x.date, {corr('x.rv', 'y.rv')} AS c FROM placed x JOIN placed y ON x.date = y.date AND x.code = y.code AND list_position({list(FACTORS)!r}, x.factor) < list_position({list(FACTORS)!r}, y.factor) GROUP BY ALL HAVING count(*) >= 10",
    "alike": f"SELECT a, b, count(*) AS n, {r('avg(c)')} AS corr, {r('stddev_pop(c)')} AS corr_std FROM daily WHERE c IS NOT NULL GROUP BY a, b",
}


@QUERIES.add(query("SELECT * FROM alike", "long", **_SIMILAR))
def factor_similarity(s, d):
    return ev.similarity(factors(s, d), FACTORS)


@QUERIES.add(query("SELECT a AS factor, " + ", ".join(f"max(corr) FILTER (b = '{f}') AS {f}" for f in FACTORS) + " FROM every GROUP BY a", "long", **_SIMILAR, every="SELECT a, b, corr FROM alike UNION ALL SELECT b, a, corr FROM alike UNION ALL SELECT DISTINCT factor, factor, 1.0 FROM long"))
def similarity_matrix(s, d):
    return ev.mirrored(ev.similarity(factors(s, d), FACTORS), FACTORS)


@QUERIES.add(query(f"SELECT factor, count(value) AS n, {r('(count(value) * 1.0 / (SELECT count(DISTINCT code) * count(DISTINCT date) FROM factor))')} AS coverage FROM long GROUP BY factor", "long"))
def factor_coverage(s, d):
    return ev.coverage(long(s, d))


@QUERIES.add(query(f"SELECT date, code, {r('(coalesce((mom - a) / nullif(b, 0), 0) / 2 - coalesce((rev - c) / nullif(e, 0), 0) / 2)')} AS value FROM factor, m", "factor", m="SELECT avg(mom) AS a, stddev_samp(mom) AS b, avg(rev) AS c, stddev_samp(rev) AS e FROM factor"))
def combined_factor(s, d):
    """The scalars stay in the plan: one row, broadcast."""
    f = factors(s, d)
    m = f.agg(F.avg("mom").alias("a"), F.stddev_samp("mom").alias("b"), F.avg("rev").alias("c"), F.stddev_samp("rev").alias("e"))
    z = lambda x, a, b: F.coalesce(F.try_divide(F.col(x) - F.col(a), F.col(b)), F.lit(0.0))
    return f.join(F.broadcast(m)).select("date", "code", rounded((z("mom", "a", "b") - z("rev", "c", "e")) / 2, 6).alias("value"))


_SECTORS = {
    "own": "SELECT l.date, l.factor, l.value, l.fwd, avg(l.value) OVER (PARTITION BY l.date, l.factor, p.sector) AS inside, avg(l.value) OVER (PARTITION BY l.date, l.factor) AS middle FROM pairs l JOIN panel p USING (date, code)",
    "daily": f"SELECT date, factor, {corr('value', 'fwd')} AS a, {corr('(value - inside)', 'fwd')} AS b, sum((inside - middle) * (inside - middle)) / CASE WHEN sum((value - middle) * (value - middle)) > 1e-12 THEN sum((value - middle) * (value - middle)) END AS r2 FROM own GROUP BY date, factor HAVING count(*) >= 5",
    "sectors": "SELECT factor, avg(a) AS a, avg(b) AS b, avg(r2) AS r2 FROM daily GROUP BY factor",
}


@QUERIES.add(query(f"SELECT factor, {r('a')} AS ic_before, {r('b')} AS ic_after, {r('(CASE WHEN abs(a) > 1e-10 THEN b / a END)')} AS kept, {r('r2')} AS r2 FROM sectors", "pairs", "panel", **_SECTORS))
def sector_neutrality(s, d):
    return ev.sector_neutral(long(s, d), brand_week(s, d))


@QUERIES.add(query(f"SELECT factor, {r('r2')} AS r2 FROM sectors", "pairs", "panel", **_SECTORS))
def sector_r2(s, d):
    return ev.sector_neutral(long(s, d), brand_week(s, d)).select("factor", "r2")


@QUERIES.add(query(f"SELECT p.date, p.code, {r('(f.mom - CASE WHEN p.sector IS NULL THEN 0 ELSE avg(f.mom) OVER (PARTITION BY p.date, p.sector) END)')} AS value FROM (SELECT date, code, CASE WHEN code <> 'Brand#7' THEN sector END AS sector FROM panel) p JOIN factor f USING (date, code)", "factor", "panel"))
def industry_neutralize(s, d):
    """Values less their industry's mean; rows without an industry keep theirs."""
    named = brand_week(s, d).select("date", "code", F.when(F.col("code") != "Brand#7", F.col("sector")).alias("sector"))
    mean = F.avg("mom").over(Window.partitionBy("date", "sector"))
    return factors(s, d).join(named, ["date", "code"]).select("date", "code", rounded(F.when(F.col("sector").isNull(), F.col("mom")).otherwise(F.col("mom") - mean), 6).alias("value"))


# buckets and turnover

_MOM = "factor = 'mom'"


def mom(s, d) -> DataFrame:
    return long(s, d).filter(_MOM)


@QUERIES.add(query(f"SELECT date, code, bucket FROM bucket WHERE {_MOM}", "bucket"))
def quantile_bucket(s, d):
    return ev.bucketed(mom(s, d)).select("date", "code", "bucket")


_EDGES = {
    "edges": f"SELECT date, list_distinct(list_sort(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM long WHERE {_MOM} AND value IS NOT NULL GROUP BY date",
}


@QUERIES.add(query(f"SELECT date, code, CAST(CASE WHEN len(e) > 1 THEN greatest(1, len(list_filter(e, lambda x: x < value))) END AS INT) AS bucket FROM long JOIN edges USING (date) WHERE {_MOM} AND value IS NOT NULL", "long", **_EDGES))
def value_buckets(s, d):
    return ev.value_buckets(mom(s, d)).drop("factor")


@QUERIES.add(query(f"SELECT factor, bucket, count(*) AS days, {r('avg(m)')} AS mean_return FROM (SELECT date, factor, bucket, avg(fwd) AS m FROM bucket GROUP BY date, factor, bucket) GROUP BY factor, bucket", "bucket"))
def quantile_returns(s, d):
    daily = ev.bucketed(long(s, d)).groupBy("date", "factor", "bucket").agg(F.avg("fwd").alias("m"))
    return daily.groupBy("factor", "bucket").agg(F.count("*").alias("days"), rounded(F.avg("m"), 6).alias("mean_return"))


@QUERIES.add(query("SELECT date, " + ", ".join(f"{r(f'(avg(fwd) FILTER (bucket = {k}))')} AS g{k}" for k in range(1, 6)) + f", {r('(avg(fwd) FILTER (bucket = 5) - avg(fwd) FILTER (bucket = 1))')} AS long_short FROM b GROUP BY date", "long", **_EDGES, b=f"SELECT date, fwd, CASE WHEN len(e) > 1 THEN greatest(1, len(list_filter(e, lambda x: x < value))) END AS bucket FROM long JOIN edges USING (date) WHERE {_MOM} AND value IS NOT NULL"))
def group_returns(s, d):
    """Mean return of each bucket by linear quantiles, side by side, and of the top less the bottom one."""
    own = ev.value_buckets(mom(s, d)).join(mom(s, d).select("date", "code", "fwd"), ["date", "code"])
    wide = own.groupBy("date").pivot("bucket", [1, 2, 3, 4, 5]).agg(F.avg("fwd"))
    return wide.select("date", *[rounded(F.col(str(k)), 6).alias(f"g{k}") for k in range(1, 6)], rounded(F.col("5") - F.col("1"), 6).alias("long_short"))


@QUERIES.add(query(f"SELECT factor, date, {r('r')} AS long_short FROM legs", "legs"))
def long_short_series(s, d):
    return ev.leg_returns(ev.bucketed(long(s, d))).select("factor", "date", rounded(F.col("r"), 6).alias("long_short"))


@QUERIES.add(query(f"SELECT factor, {r(corr('b', 'k'))} AS monotonicity FROM m GROUP BY factor", "bucket", m="SELECT factor, bucket * 1.0 AS b, rank() OVER (PARTITION BY factor ORDER BY avg(m)) * 1.0 AS k FROM (SELECT date, factor, bucket, avg(fwd) AS m FROM bucket GROUP BY date, factor, bucket) GROUP BY factor, bucket"))
def monotonicity(s, d):
    return ev.monotonicity(ev.bucketed(long(s, d)))


_TURNOVER = {"days_of": "SELECT factor, day, date, count(*) AS n FROM basket GROUP BY ALL", "kept": "SELECT a.factor, a.day, count(*) AS k FROM basket a JOIN basket b ON a.factor = b.factor AND a.code = b.code AND a.day = b.day + 1 GROUP BY ALL"}
_DAY_BEFORE = "FROM days_of a JOIN days_of p ON p.factor = a.factor AND p.day = a.day - 1 LEFT JOIN kept ON kept.factor = a.factor AND kept.day = a.day"


@QUERIES.add(query(f"SELECT a.factor, a.date, {r('(1 - coalesce(k, 0) / p.n)')} AS turnover {_DAY_BEFORE}", "basket", **_TURNOVER))
def basket_turnover(s, d):
    return ev.basket_turnover(ev.baskets(long(s, d))).select("factor", "date", "turnover")


@QUERIES.add(query(f"SELECT a.factor, a.date, {r('(1 - coalesce(k, 0) / (a.n + p.n - coalesce(k, 0)))')} AS turnover {_DAY_BEFORE}", "basket", **_TURNOVER))
def jaccard_turnover(s, d):
    return ev.basket_turnover(ev.baskets(long(s, d))).select("factor", "date", F.col("jaccard").alias("turnover"))


@QUERIES.add(query("SELECT a.date, a.code FROM basket a WHERE factor = 'mom' AND NOT EXISTS (SELECT 1 FROM basket b WHERE b.factor = 'mom' AND b.code = a.code AND b.day = a.day + 1)", "basket"))
def holdings_sold(s, d):
    held = ev.baskets(mom(s, d))
    following = held.select("code", (F.col("day") - 1).alias("day"))
    return held.join(following, ["code", "day"], "left_anti").select("date", "code")


_RANKS = {"k": f"SELECT factor, day, code, {place('value', 'day, factor')} AS rv, count(*) OVER (PARTITION BY day, factor) AS n FROM long JOIN days USING (date) WHERE value IS NOT NULL"}
_TWO_DAYS = "FROM k a JOIN k b ON a.factor = b.factor AND a.code = b.code AND a.day = b.day + 1 GROUP BY a.factor, a.day HAVING count(*) >= 3"


@QUERIES.add(query(f"SELECT a.factor, a.day, {r('(1 - ' + corr('a.rv', 'b.rv') + ')')} AS turnover {_TWO_DAYS}", "long", "days", **_RANKS))
def rank_autocorr_turnover(s, d):
    return ev.rank_turnover(long(s, d)).drop("rank_change")


@QUERIES.add(query(f"SELECT a.factor, a.day, {r('avg(abs(a.rv / a.n - b.rv / b.n))')} AS rank_change {_TWO_DAYS}", "long", "days", **_RANKS))
def mean_rank_change(s, d):
    return ev.rank_turnover(long(s, d)).drop("turnover")


@QUERIES.add(query(f"SELECT date, {r('(avg(fwd) FILTER (value >= hi) - avg(fwd) FILTER (value <= lo))')} AS spread FROM pairs JOIN q USING (date) WHERE {_MOM} GROUP BY date", "pairs", q=f"SELECT date, quantile_cont(value, 0.8) AS hi, quantile_cont(value, 0.2) AS lo FROM pairs WHERE {_MOM} GROUP BY date"))
def top_bottom_spread(s, d):
    """Codes at or above the 80th against those at or below the 20th linear percentile of the date."""
    own = ev.complete(mom(s, d))
    cuts = own.groupBy("date").agg(F.percentile("value", F.lit(0.8)).alias("hi"), F.percentile("value", F.lit(0.2)).alias("lo"))
    high, low = F.when(F.col("value") >= F.col("hi"), F.col("fwd")), F.when(F.col("value") <= F.col("lo"), F.col("fwd"))
    return own.join(cuts, "date").groupBy("date").agg(rounded(F.avg(high) - F.avg(low), 6).alias("spread"))


@QUERIES.add(query(f"SELECT date, {r('(avg(fwd) FILTER (pr >= 0.8))')} AS long_leg, {r('(avg(fwd) FILTER (pr <= 0.2))')} AS short_leg, count(*) AS n FROM (SELECT date, fwd, {place('value', 'date')} / count(*) OVER (PARTITION BY date) AS pr FROM pairs WHERE {_MOM}) GROUP BY date HAVING count(*) >= 5", "pairs"))
def long_short_daily(s, d):
    own = ev.complete(mom(s, d))
    share = average_rank(F.col("value"), ["date"]) / F.count("*").over(Window.partitionBy("date"))
    return own.withColumn("pr", share).groupBy("date").agg(rounded(F.avg(F.when(F.col("pr") >= 0.8, F.col("fwd"))), 6).alias("long_leg"), rounded(F.avg(F.when(F.col("pr") <= 0.2, F.col("fwd"))), 6).alias("short_leg"), F.count("*").alias("n")).filter("n >= 5")


# truth

def truth(s, d) -> DataFrame:
    """Submitted values, and a truth that differs, or is missing, by a rule."""
    k = F.substring("code", 7, 9).cast("int")
    value = F.when((k + F.month("date") * 31 + F.dayofmonth("date")) % 50 == 0, F.col("mom") * 1.5 + 0.001).when((k + F.dayofmonth("date")) % 41 != 0, F.col("mom"))
    return factors(s, d).select("date", "code", F.col("mom").alias("submitted"), value.alias("truth"))


_BOTH = "(WHERE truth IS NOT NULL AND submitted IS NOT NULL)"
_DAILY_TRUTH = {
    "placed": f"SELECT *, {place('submitted', 'date')} AS a, {place('truth', 'date')} AS b FROM truth WHERE truth IS NOT NULL AND submitted IS NOT NULL",
    "daily": f"SELECT date, {corr('a', 'b')} AS rho, {corr('submitted', 'truth')} AS c FROM placed GROUP BY date HAVING count(*) >= 3",
}


@QUERIES.add(query(f"""SELECT count(*) AS n, count(*) FILTER {_BOTH} AS overlap, count(*) FILTER (abs(submitted - truth) <= 1e-8) AS exact, {r('max(abs(submitted - truth))')} AS max_error,
  {r('avg(abs(submitted - truth))')} AS mean_error, {r('(SELECT avg(rho) FROM daily)')} AS mean_spearman, {r('(SELECT avg(c) FROM daily)')} AS mean_pearson FROM truth""", "truth", **_DAILY_TRUTH))  # fmt: skip
def truth_compare(s, d):
    return decisions.truth_metrics(truth(s, d))


@QUERIES.add(query(f"SELECT date, {r('c')} AS corr FROM daily", "truth", **_DAILY_TRUTH))
def truth_daily_corr(s, d):
    return decisions.daily_truth_corr(truth(s, d)).select("date", rounded(F.col("pearson"), 6).alias("corr"))


@QUERIES.add(query("SELECT CASE WHEN overlap < 0.9 THEN 'not_compared' WHEN exact >= 0.99 AND worst <= 1e-8 THEN 'passed' WHEN exact >= 0.9 THEN 'partial' ELSE 'failed' END AS status, overlap, exact FROM m", "truth", m=f"SELECT {r(f'(count(*) FILTER {_BOTH} / count(submitted))')} AS overlap, {r(f'(count(*) FILTER (abs(submitted - truth) <= 1e-8) / count(*) FILTER {_BOTH})')} AS exact, max(abs(submitted - truth)) AS worst FROM truth"))
def truth_status(s, d):
    return decisions.truth_status(truth(s, d))


@QUERIES.add(query(f"SELECT count(*) AS n, count(truth) AS filled, {r('(count(truth) / count(*))')} AS coverage, CAST(coalesce(sum(k) FILTER (k > 1), 0) AS BIGINT) AS duplicate_rows, count(truth) = 0 AS is_empty FROM (SELECT truth, 1 AS one, count(*) OVER (PARTITION BY date, code) AS k FROM truth)", "truth"))
def truth_frame_quality(s, d):
    return decisions.truth_quality(truth(s, d))


# decisions on the evidence of a factor

_EVIDENCE = {
    **_OOS,
    **_SECTORS,
    **_TURNOVER,
    "moves": "SELECT a.factor, avg(1 - coalesce(k, 0) / p.n) AS turnover " + _DAY_BEFORE + " GROUP BY a.factor",
    "covered": "SELECT factor, count(value) / count(*) AS coverage FROM long GROUP BY factor",
    "steady": f"SELECT factor, {corr('b', 'k')} AS monotonicity FROM (SELECT factor, bucket * 1.0 AS b, rank() OVER (PARTITION BY factor ORDER BY avg(m)) * 1.0 AS k FROM (SELECT date, factor, bucket, avg(fwd) AS m FROM bucket GROUP BY date, factor, bucket) GROUP BY factor, bucket) GROUP BY factor",
    "walk": "SELECT factor, date, sum(ln(greatest(1 + r, 1e-9))) OVER (PARTITION BY factor ORDER BY date) AS l FROM legs",
    "falls": "SELECT factor, min(exp(l - top) - 1) AS drawdown FROM (SELECT factor, l, greatest(0, max(l) OVER (PARTITION BY factor ORDER BY date)) AS top FROM walk) GROUP BY factor",
    "paid": "SELECT factor, avg(r) AS r FROM legs GROUP BY factor",
    "thirds": "SELECT factor, sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS good FROM (SELECT factor, third, avg(r) AS m FROM (SELECT factor, r, ntile(3) OVER (PARTITION BY factor ORDER BY date) AS third FROM legs) GROUP BY factor, third) GROUP BY factor",
    "evidence": f"""SELECT t.factor, t.days, t.ic_mean, t.ic_mean / nullif(t.ic_std, 0) AS icir, t.t, {_erfc('t.t')} AS p, c.coverage, m.turnover, s.monotonicity, f.drawdown,
      CASE WHEN abs(h.a) > 1e-10 THEN h.b / h.a END AS kept, CASE WHEN abs(h.a) > 1e-10 THEN (h.b - h.a) / abs(h.a) END AS decay, CASE WHEN abs(n.a) > 1e-10 THEN n.b / n.a END AS neutral, sign(t.ic_mean) * p.r > 0.005 * m.turnover AS survives, CASE WHEN t.ic_mean < 0 THEN 3 - g.good ELSE g.good END AS segments
      FROM tests t JOIN covered c USING (factor) LEFT JOIN moves m USING (factor) LEFT JOIN steady s USING (factor) LEFT JOIN falls f USING (factor) LEFT JOIN halves h USING (factor) LEFT JOIN sectors n USING (factor) LEFT JOIN paid p USING (factor) LEFT JOIN thirds g USING (factor)""",
}
_NEEDS = ("tests", "legs", "basket", "panel", "pairs", "bucket")


def evidence(s, d) -> DataFrame:
    return decisions.evidence(long(s, d), brand_week(s, d))


@QUERIES.add(query(f"""SELECT factor, days, {r('ic_mean')} AS ic_mean, {r('icir')} AS icir, {r('t', 5)} AS t, {r('p')} AS p, {r('coverage')} AS coverage, {r('turnover')} AS turnover, {r('monotonicity')} AS monotonicity,
  {r('drawdown')} AS drawdown, {r('kept', 4)} AS kept, {r('decay', 4)} AS decay, {r('neutral', 4)} AS neutral, survives, CAST(segments AS INT) AS segments FROM evidence""", *_NEEDS, **_EVIDENCE))  # fmt: skip
def factor_evidence(s, d):
    e = evidence(s, d)
    digits = {"t": 5, "kept": 4, "decay": 4, "neutral": 4}
    return e.select("factor", "days", *[rounded(F.col(c), digits.get(c, 6)).alias(c) for c in ("ic_mean", "icir", "t", "p", "coverage", "turnover", "monotonicity", "drawdown", "kept", "decay", "neutral")], "survives", "segments")


_FLAGS = {
    "low_coverage": "coverage < 0.3", "few_days": "days < 120", "weak_ic": "abs(coalesce(ic_mean, 0)) < 0.01", "weak_t": "abs(coalesce(t, 0)) < 1.65",
    "likely_null": "p > 0.8", "high_turnover": "coalesce(turnover, 0) > 0.6", "not_monotone": "abs(coalesce(monotonicity, 0)) < 0.5", "deep_drawdown": "coalesce(drawdown, 0) < -0.3",
}


@QUERIES.add(query("SELECT factor, " + ", ".join(f"{c} AS {k}" for k, c in _FLAGS.items()) + ", CASE WHEN coverage < 0.3 THEN 'reject' WHEN " + " OR ".join(list(_FLAGS.values())[1:]) + " THEN 'warn' ELSE 'ok' END AS severity FROM evidence", *_NEEDS, **_EVIDENCE))
def red_flags(s, d):
    return decisions.red_flags(evidence(s, d))


_GATES = {
    "oos_retention": ("coalesce(kept, 0) > 0", "kept >= 0.7"), "ic_significance": ("true", "abs(coalesce(ic_mean, 0)) >= 0.02"), "ic_ir": ("true", "abs(coalesce(icir, 0)) >= 0.3"),
    "time_decay": ("abs(coalesce(decay, 0)) > 0.001", "abs(decay) <= 0.2"), "cost_resilience": ("survives IS NOT NULL", "survives"), "sector_neutrality": ("neutral IS NOT NULL", "neutral >= 0.5"), "segment_consistency": ("segments IS NOT NULL", "segments >= 2"),
}
_APPLY = " + ".join(f"CASE WHEN {a} THEN 1 ELSE 0 END" for a, _ in _GATES.values())
_PASS = " + ".join(f"CASE WHEN {a} AND {b} THEN 1 ELSE 0 END" for a, b in _GATES.values())


@QUERIES.add(query("SELECT factor, " + ", ".join(f"CASE WHEN {a} THEN {b} END AS {k}" for k, (a, b) in _GATES.items()) + f", CAST({_APPLY} AS INT) AS applicable, CAST({_PASS} AS INT) AS passed_gates, ({_PASS}) >= 0.5 * ({_APPLY}) AS passed FROM evidence", *_NEEDS, **_EVIDENCE))
def validation_gates(s, d):
    return decisions.validation_gates(evidence(s, d))


@QUERIES.add(query("SELECT factor, weak_ic, noisy, costly, sector_bet, CASE WHEN weak_ic OR noisy OR costly OR sector_bet THEN 'warn' ELSE 'pass' END AS status FROM (SELECT factor, abs(coalesce(ic_mean, 0)) < 0.02 AS weak_ic, coalesce(icir, 0) < 0.3 AS noisy, coalesce(turnover, 0) > 0.7 AS costly, coalesce(neutral, 0) < 0.3 AS sector_bet FROM evidence)", *_NEEDS, **_EVIDENCE))
def evaluation_status(s, d):
    return decisions.evaluation_status(evidence(s, d))


_SCORE = "CASE WHEN p < 0.05 THEN 25 ELSE 0 END + 25 * least(1, greatest(0, coalesce(kept, 0))) + 20 * least(1, greatest(0, 1 - coalesce(turnover, 1))) + 15 * coverage + 15 * greatest(0, 1 - coalesce(alike, 0))"
_NEAREST = {"alike_placed": _SIMILAR["placed"], "alike_daily": _SIMILAR["daily"].replace("placed", "alike_placed"), "alike_pairs": _SIMILAR["alike"].replace("daily", "alike_daily"), "nearest": "SELECT factor, max(abs(corr)) AS alike FROM (SELECT a AS factor, corr FROM alike_pairs UNION ALL SELECT b, corr FROM alike_pairs) GROUP BY factor"}


@QUERIES.add(query(f"SELECT factor, score, CASE WHEN score >= 70 THEN 'SAFE' WHEN score >= 40 THEN 'REVIEW' ELSE 'REJECT' END AS verdict FROM (SELECT factor, {r(f'({_SCORE})', 4)} AS score FROM evidence LEFT JOIN nearest USING (factor))", *_NEEDS, **_EVIDENCE, **_NEAREST))
def factor_confidence(s, d):
    """A score from 0 to 100 of significance, what stays out of sample, turnover, coverage and the likeness to the most alike other factor."""
    pairs = ev.similarity(factors(s, d), FACTORS)
    both = pairs.select(F.col("a").alias("factor"), "corr").union(pairs.select("b", "corr"))
    return decisions.confidence(evidence(s, d).join(both.groupBy("factor").agg(F.max(F.abs("corr")).alias("alike")), "factor", "left"))


@QUERIES.add(None)
def bootstrap_ic(s, d):
    return inference.bootstrap_ic(ic5(s, d).select("factor", "ic"))


@QUERIES.add(None)
def shuffle_test(s, d):
    daily = ev.complete(long(s, d)).groupBy("factor", "code").agg(F.avg("value").alias("value"), F.avg("fwd").alias("fwd"))
    return inference.shuffle_test(daily.select("factor", "value", "fwd"))
