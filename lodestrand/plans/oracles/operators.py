"""One query for each panel operator, in plain SQL, from its definition and not from the formula's tree."""

from __future__ import annotations

from lodestrand.plans.layers import sql_rounded
from lodestrand.sources.panel import BRAND_WEEK_SQL

_CODE = "(PARTITION BY code ORDER BY date)"
_DATE = "(PARTITION BY date)"
_SO_FAR = "(PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def last(n: int) -> str:
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, value: str) -> str:
    """A value where all n rows of the window have x."""
    return f"CASE WHEN count({x}) OVER {last(n)} = {n} THEN {value} END"


def rolled(fn: str, x: str, n: int) -> str:
    return full(x, n, f"{fn}({x}) OVER {last(n)}")


def place(x: str, rows: str) -> str:
    """The average rank of x within a window: how many are less, and half of those equal."""
    return f"(len(list_filter(list({x}) OVER {rows}, lambda v: v < {x})) + (len(list_filter(list({x}) OVER {rows}, lambda v: v = {x})) + 1) / 2.0)"


def lags(n: int, weight) -> str:
    """A weighted sum of the last n closes; weight takes how many rows back."""
    return full("close", n, " + ".join(f"lag(close, {k}) OVER {_CODE} * {weight(k)!r}" for k in range(n)))


def _fit(n: int, value: str) -> str:
    return full("close", n, value.replace("OVER w", f"OVER {last(n)}"))


_WMA = sum(0.9**k for k in range(10))
_UP, _DOWN = "greatest(close - before, 0)", "greatest(before - close, 0)"

#: The value of each query, over a panel with rn (the row's number in its code), before (the last close), ret and market.
VALUES = {
    "safe_div": "(close - open) / nullif(volume - 100, 0)",
    "signed_power": "(close - open) * abs(close - open)",
    "vwap": "CASE WHEN coalesce(volume, 0) = 0 OR amount IS NULL THEN (open + high + low + close) / 4 ELSE amount / volume END",
    "adv_amount": rolled("avg", "amount", 20),
    "log_floor": "CASE WHEN close <> open THEN ln(CASE WHEN close - open < 1e-30 THEN 1e-30 ELSE close - open END) END",
    "if_where": "CASE WHEN close > open THEN 1.0 ELSE -1.0 END",
    "compare_flags": f"CASE WHEN close > before THEN 1.0 ELSE 0.0 END + CASE WHEN volume <= lag(volume) OVER {_CODE} THEN 1.0 ELSE 0.0 END",
    "filter_values": "CASE WHEN close > open THEN close END",
    "elementwise_max": "CASE WHEN open > close THEN open ELSE close END",
    "elementwise_fmax": f"CASE WHEN lag(close, 3) OVER {_CODE} > open THEN lag(close, 3) OVER {_CODE} ELSE open END",
    "cs_rank": f"{place('close', _DATE)} / count(close) OVER {_DATE}",
    "cs_rank_average": place("volume", _DATE),
    "cs_scale": f"CASE WHEN sum(abs(close - open)) OVER {_DATE} > 0 THEN (close - open) / sum(abs(close - open)) OVER {_DATE} ELSE 0 END",
    "indneutralize": "close - avg(close) OVER (PARTITION BY date, industry)",
    "winsorize": f"least(greatest(close, quantile_cont(close, 0.01) OVER {_DATE}), quantile_cont(close, 0.99) OVER {_DATE})",
    "zscore": f"CASE WHEN stddev_pop(amount) OVER {_DATE} > 1e-12 THEN (amount - avg(amount) OVER {_DATE}) / stddev_pop(amount) OVER {_DATE} ELSE 0 END",
    "cs_demean": f"close - avg(close) OVER {_DATE}",
    "ts_delay": f"lag(close, 3) OVER {_CODE}",
    "ts_delta": f"close - lag(close, 3) OVER {_CODE}",
    "returns": "close / before - 1",
    "forward_return": f"lead(close, 4) OVER {_CODE} / close - 1",
    "ts_sum": rolled("sum", "volume", 10),
    "ts_mean": rolled("avg", "close", 10),
    "ts_std": rolled("stddev_pop", "close", 10),
    "rolling_std": rolled("stddev_samp", "close", 10),
    "ts_min": rolled("min", "low", 10),
    "ts_max": rolled("max", "high", 10),
    "ts_rank": full("close", 10, f"{place('close', last(10))} / 10"),
    "ts_argmax": full("high", 10, f"list_position(list(high) OVER {last(10)}, max(high) OVER {last(10)})"),
    "ts_argmin": full("low", 10, f"list_position(list(low) OVER {last(10)}, min(low) OVER {last(10)})"),
    "ts_argmax_zero": full("high", 10, f"list_position(list(high) OVER {last(10)}, max(high) OVER {last(10)}) - 1"),
    "highday": full("high", 10, f"10 - list_position(list(high) OVER {last(10)}, max(high) OVER {last(10)})"),
    "lowday": full("low", 10, f"10 - list_position(list(low) OVER {last(10)}, min(low) OVER {last(10)})"),
    "ts_product": full("close / open", 5, " * ".join(f"lag(close / open, {k}) OVER {_CODE}" for k in range(5))),
    "ts_corr": full("close", 10, f"corr(close, volume) OVER {last(10)}"),
    "ts_corr_partial": f"CASE WHEN rn >= 2 THEN corr(close, volume) OVER {last(10)} END",
    "ts_cov": full("close", 10, f"covar_samp(close, volume) OVER {last(10)}"),
    "ts_decay_linear": lags(10, lambda k: (10 - k) / 55),
    "wma": lags(10, lambda k: 0.9**k / _WMA),
    "sma_gtja": f"list_reduce(list(close) OVER {_SO_FAR}, lambda y, v: (2 * v + 5 * y) / 7)",
    "ts_count": full("close", 10, f"sum(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) OVER {last(10)}"),
    "ts_sumif": full("volume", 10, f"sum(CASE WHEN close > open THEN volume ELSE 0 END) OVER {last(10)}"),
    "sumac": f"sum(volume) OVER {_SO_FAR}",
    "regbeta_seq": _fit(10, "regr_slope(close, rn) OVER w"),
    "regbeta": full("ret", 20, f"regr_slope(ret, market) OVER {last(20)}"),
    "regresi": _fit(10, "close - regr_intercept(close, volume) OVER w - volume * regr_slope(close, volume) OVER w"),
    "ts_quantile": rolled("quantile_cont", "close", 20).replace("quantile_cont(close)", "quantile_cont(close, 0.8)"),
    "ts_ols_r2": _fit(10, "regr_r2(close, rn) OVER w"),
    "ts_ols_residual": _fit(10, "close - regr_intercept(close, rn) OVER w - rn * regr_slope(close, rn) OVER w"),
    "beta": full("ret", 60, f"regr_slope(ret, market) OVER {last(60)}"),
    "rsi": full("before", 14, f"100 - 100 / (1 + avg({_UP}) OVER {last(14)} / nullif(avg({_DOWN}) OVER {last(14)}, 0))"),
    "bollinger": full("close", 20, f"(close - avg(close) OVER {last(20)}) / nullif(2 * stddev_pop(close) OVER {last(20)}, 0)"),
    "williams_r": full("high", 32, f"50 - 100 * (max(high) OVER {last(32)} - close) / nullif(max(high) OVER {last(32)} - min(low) OVER {last(32)}, 0)"),
    "drawdown": f"close / max(close) OVER {_SO_FAR} - 1",
    "cum_nav": f"CASE WHEN rn > 1 THEN close / first_value(close) OVER {_SO_FAR} END",
    "qlib_expression": f"(close / lag(close, 20) OVER {_CODE} - 1) * ln(volume / lag(volume, 20) OVER {_CODE})",
}

PANEL = f"""
  panel AS ({BRAND_WEEK_SQL}),
  told AS (SELECT *, CAST(row_number() OVER {_CODE} AS DOUBLE) AS rn, lag(close) OVER {_CODE} AS before FROM panel),
  moved AS (SELECT *, close / before - 1 AS ret FROM told),
  rows AS (SELECT *, avg(ret) OVER {_DATE} AS market FROM moved)"""

_RSRS = f"""WITH {PANEL},
  slopes AS (SELECT date, code, CASE WHEN var_pop(low) OVER w > 1e-18 THEN regr_slope(high, low) OVER w END AS s FROM rows WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING)),
  z AS (SELECT date, code, CASE WHEN count(s) OVER w >= 250 THEN (s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0) END AS value FROM slopes WINDOW w AS {last(600)})
  SELECT date, code, {sql_rounded('value', 6)} AS value FROM z"""


def sql() -> dict[str, str]:
    out = {name: f"WITH {PANEL} SELECT date, code, {sql_rounded('value', 6)} AS value FROM (SELECT date, code, CAST({value} AS DOUBLE) AS value FROM rows) q" for name, value in VALUES.items()}
    return out | {"rsrs": _RSRS}
