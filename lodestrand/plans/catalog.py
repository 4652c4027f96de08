"""All queries of the library's own operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.plans import evaluation_queries, nav_queries, portfolio_queries, warehouse_queries
from lodestrand.plans.factors import sets
from lodestrand.plans.layers import compute, to_sql
from lodestrand.plans.oracles import operators
from lodestrand.sources.panel import BRAND_WEEK_SQL, brand_week

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of queries, each a function over DataFrames with SQL of its own.
MODULES = (evaluation_queries, nav_queries, portfolio_queries, warehouse_queries)

#: One formula for each panel operator.
OPERATORS = {
    "safe_div": "(close - open) / (volume - 100)", "signed_power": "(close - open) ^ 2", "vwap": "vwap", "adv_amount": "MEAN(amount, 20)", "log_floor": "FLOORLOG(close - open)", "if_where": "IF(close > open, 1, -1)",
    "compare_flags": "(close > DELAY(close, 1)) + (volume <= DELAY(volume, 1))", "filter_values": "FILTER(close, close > open)", "elementwise_max": "MAX(open, close)", "elementwise_fmax": "FMAX(DELAY(close, 3), open)",
    "cs_rank": "RANK(close)", "cs_rank_average": "RANKAVG(volume)", "cs_scale": "SCALE(close - open)", "indneutralize": "NEUT(close, industry)", "winsorize": "WINSOR(close, 0.01)", "zscore": "ZSCORE(amount)", "cs_demean": "close - XMEAN(close)",
    "ts_delay": "DELAY(close, 3)", "ts_delta": "DELTA(close, 3)", "returns": "RET(close, 1)", "forward_return": "DELAY(close, -4) / close - 1", "ts_sum": "SUM(volume, 10)", "ts_mean": "MEAN(close, 10)", "ts_std": "STD(close, 10)", "rolling_std": "STD1(close, 10)",
    "ts_min": "TSMIN(low, 10)", "ts_max": "TSMAX(high, 10)", "ts_rank": "TSRANK(close, 10)", "ts_argmax": "ARGMAX(high, 10)", "ts_argmin": "ARGMIN(low, 10)", "highday": "HIGHDAY(high, 10)", "lowday": "LOWDAY(low, 10)", "ts_argmax_zero": "ARGMAX(high, 10) - 1", "ts_product": "PROD(close / open, 5)",
    "ts_corr": "CORR(close, volume, 10)", "ts_corr_partial": "CORR2(close, volume, 10)", "ts_cov": "COV(close, volume, 10)", "ts_decay_linear": "DECAY(close, 10)", "wma": "WMA(close, 10)", "sma_gtja": "SMA(close, 7, 2)", "ts_count": "COUNT(close > open, 10)",
    "ts_sumif": "SUMIF(volume, close > open, 10)", "sumac": "SUMAC(volume)", "regbeta_seq": "SLOPE(close, 10)", "regbeta": "REGBETA(returns, XMEAN(returns), 20)", "regresi": "REGRESI(close, volume, 10)", "ts_quantile": "QUANTILE(close, 20, 0.8)", "ts_ols_r2": "RSQUARE(close, 10)", "ts_ols_residual": "RESIDUAL(close, 10)",
    "beta": "REGBETA(returns, XMEAN(returns), 60)", "rsi": "100 - 100 / (1 + MEAN(GREATEST(DELTA(close, 1), 0), 14) / MEAN(GREATEST(-1 * DELTA(close, 1), 0), 14))", "bollinger": "(close - MEAN(close, 20)) / (2 * STD(close, 20))", "williams_r": "-100 * (TSMAX(high, 32) - close) / (TSMAX(high, 32) - TSMIN(low, 32)) + 50",
    "rsrs": "LASTZ(OLDSLOPE(high, low, 18), 600, 250)", "drawdown": "close / CUMMAX(close) - 1", "cum_nav": "CUMPROD(1 + returns)", "qlib_expression": "(close / Ref(close, 20) - 1) * Log(volume / Ref(volume, 20))",
}


def _formula_query(formulas: dict[str, str]) -> Query:
    return lambda spark, d: compute(brand_week(spark, d), formulas, 6)


def _factor_groups() -> dict[str, dict[str, str]]:
    """Factor sets in groups that make plans of a bounded size."""
    def groups(name: str, formulas: dict[str, str], size: int) -> dict[str, dict[str, str]]:
        keys = list(formulas)
        return {f"{name}_{k // size + 1:02d}": {c: formulas[c] for c in keys[k : k + size]} for k in range(0, len(keys), size)}

    wq = sets.factor_set("wq101")
    del wq["alpha84"]  # its powers reach 1e291: a query of its own gives digits and power of ten
    prices = {k: v for k, v in sets.quant33().items() if not set("roe_ttm roa_ttm net_margin debt_to_asset asset_turnover revenue_yoy profit_yoy eps_yoy".split()) & {k}}
    return groups("alpha101", wq, 9) | groups("alpha158", sets.alpha158(), 40) | {"gtja191": sets.gtja191(), "quant33": prices}


#: Stand-ins for fundamentals and style inputs, as functions of price, volume and amount.
_STANDINS = {
    "net_profit_ttm": "amount * 0.1", "equity": "amount", "assets": "amount * 2", "revenue_ttm": "amount * 0.4", "liabilities": "amount * 0.8", "revenue_yoy": "0.05 * close", "profit_yoy": "0.01 * close", "eps_yoy": "0.02 * close",
    "total_shares": "100000 + volume", "book_value_per_share": "close * 0.5 + 1", "eps_ttm": "close * 0.05", "net_profit_yoy": "0.1 * close", "debt_to_equity": "volume / 1000",
}


def _stand_in(formula: str) -> str:
    import re

    return re.sub(r"[a-z_]+", lambda m: f"({_STANDINS[m[0]]})" if m[0] in _STANDINS else m[0], formula)


def _ratio_groups() -> dict[str, dict[str, str]]:
    quant = {k: _stand_in(v) for k, v in sets.quant33().items() if any(n in v for n in sets.FUNDAMENTALS)}
    return {"quant33_ratios": quant, "barra": {k: _stand_in(v) for k, v in sets.barra().items()}}


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """Several sets on one panel in one select, names with the set's prefix."""
    return compute(brand_week(spark, d), _BATCH, 6)


def _of_prices() -> dict[str, str]:
    """The factors of the set of 33 that need nothing but a panel."""
    return {k: v for k, v in sets.quant33().items() if not any(n in v for n in sets.FUNDAMENTALS)}


_BATCH = {**{f"gtja191_{k}": v for k, v in sets.gtja191().items()}, **{f"quant33_{k}": v for k, v in _of_prices().items()}}


def alpha84(spark: SparkSession, d: str) -> DataFrame:
    """(date, code, digits, power): alpha84 = digits * 10 ** power, as its powers reach 1e291; both null where it is null, 0 where
    it is 0. Beyond 1e300 and below 1e-300 doubles have no digits left, so those are null too."""
    x = compute(brand_week(spark, d), {"x": sets.factor_set("wq101")["alpha84"]})
    x = x.withColumn("x", F.when((F.col("x") == 0) | F.abs("x").between(1e-300, 1e300), F.col("x")))
    power = F.floor(F.log10(F.nullif(F.abs("x"), F.lit(0.0))) + 1e-9)
    return x.select("date", "code", F.when(F.col("x") == 0, 0.0).otherwise(F.round(F.try_divide(F.col("x"), F.pow(F.lit(10.0), power)), 5)).alias("digits"), F.when(F.col("x") == 0, 0).otherwise(power).cast("double").alias("power"))


def _alpha84_sql() -> str:
    inner = to_sql(BRAND_WEEK_SQL, {"x": sets.factor_set("wq101")["alpha84"]}, None)
    power = "floor(log10(nullif(abs(x), 0)) + 1e-9)"
    inner = f"SELECT date, code, CASE WHEN x = 0 OR abs(x) BETWEEN 1e-300 AND 1e300 THEN x END AS x FROM ({inner}) i"
    return f"SELECT date, code, CASE WHEN x = 0 THEN 0.0 ELSE round(x / pow(10.0, {power}), 5) END AS digits, CAST(CASE WHEN x = 0 THEN 0 ELSE {power} END AS DOUBLE) AS power FROM ({inner}) q"


def _formulas() -> dict[str, dict[str, str]]:
    return {**{k: {"value": f} for k, f in OPERATORS.items()}, **_factor_groups(), **_ratio_groups(), "batch_factor_sets": _BATCH}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {k: _formula_query(f) for k, f in _formulas().items()}
    out["alpha84"] = alpha84
    for module in MODULES:
        out |= {k: q.spark for k, q in module.QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {k: to_sql(BRAND_WEEK_SQL, f) for k, f in _formulas().items()}
    out |= operators.sql()
    out["alpha84"] = _alpha84_sql()
    for module in MODULES:
        for k, q in module.QUERIES.items():
            out.pop(k, None)
            if q.sql:
                out[k] = q.sql
    return out
