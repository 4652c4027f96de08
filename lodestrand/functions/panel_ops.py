"""The panel operators, each once for Spark columns and once as SQL text.

A panel has one row for each (date, code). Time operators look back along a code's rows, cross
operators across a date's codes. Missing is NULL and nothing else: every division by zero, logarithm
of no positive number and empty window gives NULL. A window of n rows has a value if all n are there.
Windows are counted in rows and cut to whole numbers; results of windows over which ties decide are rounded to
twelve places, so that the last bits of a sum never decide a rank.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 12
#: A correlation this near to one is one; two points always are, but for the last bits.
ONE = 1e-7


def over(n: int | None, skip: int = 0):
    """The last n rows of a code, without the newest ``skip`` of them; None: all rows so far."""
    w = Window.partitionBy("code").orderBy("date")
    return w.rowsBetween(Window.unboundedPreceding if n is None else -(n - 1 + skip), -skip)


def sql_over(n: int | None, skip: int = 0) -> str:
    start = "UNBOUNDED" if n is None else str(n - 1 + skip)
    end = "CURRENT ROW" if not skip else f"{skip} PRECEDING"
    return f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {start} PRECEDING AND {end})"


def lagged(x: Column, n: int) -> Column:
    w = Window.partitionBy("code").orderBy("date")
    return F.lag(x, n).over(w) if n >= 0 else F.lead(x, -n).over(w)


def sql_lagged(x: str, n: int) -> str:
    return f"{'lag' if n >= 0 else 'lead'}({x}, {abs(n)}) OVER (PARTITION BY code ORDER BY date)"


def clean(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < 1.7e308), x)


def full(n: int, x: Column, value: Column) -> Column:
    return F.when(F.count(x).over(over(n)) == n, value)


def sql_full(n: int, x: str, value: str) -> str:
    return f"CASE WHEN count({x}) {sql_over(n)} = {n} THEN {value} END"


def snap(x: Column) -> Column:
    return F.round(x, DIGITS)


def sql_snap(x: str) -> str:
    return f"round({x}, {DIGITS})"


def average_rank(x: Column, by: list[str]) -> Column:
    """Ranks from 1 among the rows with a value; ties share the mean of their ranks."""
    place = F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), place + (ties - 1) / 2.0)


def sql_average_rank(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END"


def percent_rank(x: Column, by: list[str]) -> Column:
    return F.try_divide(average_rank(x, by), F.count(x).over(Window.partitionBy(*by)).cast("double"))


def sql_percent_rank(x: str, by: str) -> str:
    return f"({sql_average_rank(x, by)}) / nullif(count({x}) OVER (PARTITION BY {by}), 0)"


def pair_corr(x: Column, y: Column, w=None) -> Column:
    """Pearson over the complete pairs of a window or group; NULL if either hardly varies."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    of = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    sa, sb = of(F.stddev_pop(a)), of(F.stddev_pop(b))
    moves = (sa > 1e-9 * F.abs(of(F.avg(a)))) & (sb > 1e-9 * F.abs(of(F.avg(b)))) & (sa > 1e-12) & (sb > 1e-12)
    r = F.try_divide(of(F.covar_pop(a, b)), sa * sb)
    return F.when(moves, F.when(F.abs(r) > 1 - ONE, F.signum(r)).otherwise(r))


def sql_pair_corr(x: str, y: str, o: str = "") -> str:
    a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    sa, sb = f"stddev_pop({a}) {o}", f"stddev_pop({b}) {o}"
    moves = f"{sa} > 1e-9 * abs(avg({a}) {o}) AND {sb} > 1e-9 * abs(avg({b}) {o}) AND {sa} > 1e-12 AND {sb} > 1e-12"
    r = f"(covar_pop({a}, {b}) {o} / nullif({sa} * {sb}, 0))"
    return f"CASE WHEN {moves} THEN CASE WHEN abs({r}) > 1 - {ONE} THEN sign({r}) ELSE {r} END END"


@dataclass(frozen=True)
class Op:
    """kind: "row", "time" or "cross". spark and sql get the arguments; those that are windows or
    other numbers come as Python numbers. back: rows that it looks back, from its numbers."""

    kind: str
    spark: Callable[..., Column]
    sql: Callable[..., str]
    numbers: tuple[int, ...] = ()
    back: Callable[..., int] = lambda *n: 0


def _flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def _sql_flag(c: str) -> str:
    return f"(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"


def _compare(op: str, spark) -> Op:
    return Op("row", lambda a, b: _flag(spark(a, b)), lambda a, b: _sql_flag(f"({a}) {op} ({b})"))


def _pow(a: Column, p) -> Column:
    """sign(a) * abs(a) ** p; squares and roots as such, which both engines compute alike."""
    p = F.lit(float(p)) if isinstance(p, (int, float)) else p
    return clean(F.signum(a) * F.pow(F.abs(a), p))


def _finite(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def _agg(fn, sql_fn: str, rounded: bool = False) -> Op:
    spark = lambda x, n: full(n, x, fn(x).over(over(n)))
    sql = lambda x, n: sql_full(n, x, f"{sql_fn}({x}) {sql_over(n)}")
    return Op("time", (lambda x, n: snap(spark(x, n))) if rounded else spark, (lambda x, n: sql_snap(sql(x, n))) if rounded else sql, (1,), lambda n: n - 1)


def _listed(x: Column, n: int) -> Column:
    return F.collect_list(x).over(over(n))


def _ts_rank(x: Column, n: int) -> Column:
    xs = _listed(x, n)
    less = F.size(F.filter(xs, lambda v: v < F.element_at(xs, -1)))
    same = F.size(F.filter(xs, lambda v: v == F.element_at(xs, -1)))
    return full(n, x, (less + (same + 1) / 2.0) / n)


def _sql_ts_rank(x: str, n: int) -> str:
    xs = f"list({x}) {sql_over(n)}"
    return sql_full(n, x, f"(len(list_filter({xs}, lambda v: v < {x})) + (len(list_filter({xs}, lambda v: v = {x})) + 1) / 2.0) / {n}")


def _extreme(fn, sql_fn: str, flip: bool = False) -> Op:
    def spark(x: Column, n: int) -> Column:
        at = F.array_position(_listed(x, n), fn(x).over(over(n))).cast("double")
        return full(n, x, n - at if flip else at)

    def sql(x: str, n: int) -> str:
        at = f"list_position(list({x}) {sql_over(n)}, {sql_fn}({x}) {sql_over(n)})"
        return sql_full(n, x, f"CAST({f'{n} - ' if flip else ''}{at} AS DOUBLE)")

    return Op("time", spark, sql, (1,), lambda n: n - 1)


def _weighted(weights: Callable[[int], list[float]]) -> Op:
    """A sum of the window's rows, oldest first, with fixed weights."""
    def spark(x: Column, n: int) -> Column:
        w = F.array(*[F.lit(v) for v in weights(n)])
        return full(n, x, F.aggregate(F.zip_with(_listed(x, n), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))

    def sql(x: str, n: int) -> str:
        terms = " + ".join(f"{w!r} * {sql_lagged(x, n - 1 - k)}" for k, w in enumerate(weights(n)))
        return sql_full(n, x, terms)

    return Op("time", lambda x, n: snap(spark(x, n)), lambda x, n: sql_snap(sql(x, n)), (1,), lambda n: n - 1)


def _decay_weights(n: int) -> list[float]:
    return [k / (n * (n + 1) / 2) for k in range(1, n + 1)]


def _wma_weights(n: int) -> list[float]:
    w = [0.9 ** (n - 1 - k) for k in range(n)]
    return [x / sum(w) for x in w]


def _paired(x: Column, y: Column, n: int, value: Column, least: int | None = None) -> Column:
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    return F.when(F.count(both).over(over(n)) >= (least or n), value)


def _corr(x: Column, y: Column, n: int) -> Column:
    return snap(_paired(x, y, n, pair_corr(x, y, over(n))))


def _sql_paired(x: str, y: str, n: int, value: str, least: int | None = None) -> str:
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {sql_over(n)} >= {least or n} THEN {value} END"


def _sma_rows(n: int, m: int) -> int:
    """Values after which an older one of the recursion weighs less than a double's last bit."""
    import math

    return 1 if n == m else math.ceil(math.log(1e-18) / math.log(1 - m / n))


def _sma(x: Column, n: int, m: int) -> Column:
    """Y = (m x + (n - m) Y before) / n, from the first value on; a missing x keeps the Y before. The window
    counts rows with a value only, so no run of missing ones makes the recursion forget."""
    valued = Window.partitionBy("code", x.isNull()).orderBy("date").rowsBetween(1 - _sma_rows(n, m), 0)
    xs = F.collect_list(x).over(valued)
    step = F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0)), lambda y, v: (m * v + (n - m) * y) / n)
    return F.last(F.when(x.isNotNull(), step), ignorenulls=True).over(over(None))


def _sql_sma(x: str, n: int, m: int) -> str:
    return f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) {sql_over(None)}, lambda y, v: ({m} * v + {n - m} * y) / {n}.0)"


def _position() -> Column:
    return F.row_number().over(Window.partitionBy("code").orderBy("date")).cast("double")


_SQL_POSITION = "CAST(row_number() OVER (PARTITION BY code ORDER BY date) AS DOUBLE)"


def _moments(y: Column, n: int):
    """(slope, intercept at 0, R2) of a window's rows on 0 .. n - 1, all rows there."""
    xs = _listed(y, n)
    k = F.array(*[F.lit(float(i)) for i in range(n)])
    mid = (n - 1) / 2
    sxx = sum((i - mid) ** 2 for i in range(n))
    mean = F.avg(y).over(over(n))
    sxy = F.aggregate(F.zip_with(xs, k, lambda v, i: v * (i - mid)), F.lit(0.0), lambda s, v: s + v)
    slope = sxy / sxx
    return slope, mean - slope * mid, F.when(F.var_pop(y).over(over(n)) > 1e-18, F.try_divide(sxy * sxy, sxx * F.var_pop(y).over(over(n)) * n)), mid


def _sql_moments(y: str, n: int):
    mid = (n - 1) / 2
    sxx = sum((i - mid) ** 2 for i in range(n))
    sxy = "(" + " + ".join(f"{i - mid} * {sql_lagged(y, n - 1 - i)}" for i in range(n)) + ")"
    slope = f"({sxy} / {sxx})"
    mean, var = f"avg({y}) {sql_over(n)}", f"var_pop({y}) {sql_over(n)}"
    return slope, f"({mean} - {slope} * {mid})", f"CASE WHEN {var} > 1e-18 THEN {sxy} * {sxy} / ({sxx} * {var} * {n}) END", mid


def _fit(part: str) -> Op:
    def spark(y: Column, n: int) -> Column:
        slope, start, r2, mid = _moments(y, n)
        return snap(full(n, y, {"slope": slope, "r2": r2, "rest": y - (start + slope * (n - 1))}[part]))

    def sql(y: str, n: int) -> str:
        slope, start, r2, mid = _sql_moments(y, n)
        return sql_snap(sql_full(n, y, {"slope": slope, "r2": r2, "rest": f"{y} - ({start} + {slope} * {n - 1})"}[part]))

    return Op("time", spark, sql, (1,), lambda n: n - 1)


def _beta(y: Column, x: Column, n: int) -> Column:
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    v = F.var_pop(a).over(over(n))
    return snap(_paired(x, y, n, F.when(v > 1e-18, F.try_divide(F.covar_pop(a, b).over(over(n)), v))))


def _sql_beta(y: str, x: str, n: int) -> str:
    a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    v = f"var_pop({a}) {sql_over(n)}"
    return sql_snap(_sql_paired(x, y, n, f"CASE WHEN {v} > 1e-18 THEN covar_pop({a}, {b}) {sql_over(n)} / {v} END"))


def _scale(x: Column, k: float = 1.0) -> Column:
    total = F.sum(F.abs(x)).over(Window.partitionBy("date"))
    return F.when(total > 0, F.try_divide(x, total) * k).otherwise(x * 0.0)


_BY_DATE = "OVER (PARTITION BY date)"

OPS: dict[str, Op] = {
    "ADD": Op("row", lambda a, b: a + b, lambda a, b: f"({a} + {b})"),
    "SUB": Op("row", lambda a, b: a - b, lambda a, b: f"({a} - {b})"),
    "MUL": Op("row", lambda a, b: a * b, lambda a, b: f"({a} * {b})"),
    "DIV": Op("row", lambda a, b: F.try_divide(a, b), lambda a, b: f"({a} / nullif({b}, 0))"),
    "NEG": Op("row", lambda a: -a, lambda a: f"(-({a}))"),
    "POW": Op("row", _pow, lambda a, p: _finite(f"(CASE WHEN {a} = 0 AND {p} < 0 THEN NULL ELSE sign({a}) * pow(abs({a}), {p}) END)")),
    "ABS": Op("row", lambda a: F.abs(a), lambda a: f"abs({a})"),
    "SIGN": Op("row", lambda a: F.signum(a), lambda a: f"CAST(sign({a}) AS DOUBLE)"),
    "SQRT": Op("row", lambda a: F.when(a >= 0, F.sqrt(a)), lambda a: f"(CASE WHEN {a} >= 0 THEN sqrt({a}) END)"),
    "LOG": Op("row", lambda a: snap(F.when(a > 0, F.ln(a))), lambda a: sql_snap(f"(CASE WHEN {a} > 0 THEN ln({a}) END)")),
    "FLOORLOG": Op("row", lambda a: F.when(a != 0, F.ln(F.greatest(a, F.lit(1e-30)))), lambda a: f"(CASE WHEN {a} <> 0 THEN ln(greatest({a}, 1e-30)) END)"),
    "GREATEST": Op("row", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), lambda a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END)"),
    "LEAST": Op("row", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), lambda a, b: f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END)"),
    "FMAX": Op("row", lambda a, b: F.greatest(a, b), lambda a, b: f"coalesce(greatest({a}, {b}), {a}, {b})"),
    "IF": Op("row", lambda c, a, b: F.when(F.coalesce(c > 0, F.lit(False)), a).otherwise(b), lambda c, a, b: f"(CASE WHEN {c} > 0 THEN {a} ELSE {b} END)"),
    "AND": Op("row", lambda a, b: _flag((a > 0) & (b > 0)), lambda a, b: _sql_flag(f"{a} > 0 AND {b} > 0")),
    "OR": Op("row", lambda a, b: _flag(F.coalesce(a > 0, F.lit(False)) | F.coalesce(b > 0, F.lit(False))), lambda a, b: _sql_flag(f"coalesce({a} > 0, false) OR coalesce({b} > 0, false)")),
    "LT": _compare("<", lambda a, b: a < b), "GT": _compare(">", lambda a, b: a > b), "LE": _compare("<=", lambda a, b: a <= b),
    "GE": _compare(">=", lambda a, b: a >= b), "EQ": _compare("=", lambda a, b: a == b), "NE": _compare("<>", lambda a, b: a != b),
    "NULLIF": Op("row", lambda a, b: F.when(a != b, a), lambda a, b: f"nullif({a}, {b})"),
    "COALESCE": Op("row", lambda a, b: F.coalesce(a, b), lambda a, b: f"coalesce({a}, {b})"),
    "FILTER": Op("row", lambda a, c: F.when(F.coalesce(c > 0, F.lit(False)), a), lambda a, c: f"(CASE WHEN {c} > 0 THEN {a} END)"),
    "DELAY": Op("time", lambda x, n: lagged(x, n), lambda x, n: sql_lagged(x, n), (1,), lambda n: n),
    "DELTA": Op("time", lambda x, n: x - lagged(x, n), lambda x, n: f"({x} - {sql_lagged(x, n)})", (1,), lambda n: n),
    "RET": Op("time", lambda x, n: F.try_divide(x, lagged(x, n)) - 1, lambda x, n: f"({x} / nullif({sql_lagged(x, n)}, 0) - 1)", (1,), lambda n: n),
    "SUM": _agg(F.sum, "sum", True), "MEAN": _agg(F.avg, "avg", True), "STD": _agg(F.stddev_pop, "stddev_pop", True), "STD1": _agg(F.stddev_samp, "stddev_samp", True),
    "VAR1": _agg(F.var_samp, "var_samp", True), "TSMIN": _agg(F.min, "min"), "TSMAX": _agg(F.max, "max"), "PROD": _agg(F.product, "product", True),
    "TSRANK": Op("time", _ts_rank, _sql_ts_rank, (1,), lambda n: n - 1),
    "ARGMAX": _extreme(F.max, "max"), "ARGMIN": _extreme(F.min, "min"), "HIGHDAY": _extreme(F.max, "max", True), "LOWDAY": _extreme(F.min, "min", True),
    "DECAY": _weighted(_decay_weights), "WMA": _weighted(_wma_weights),
    "CORR": Op("time", _corr, lambda x, y, n: sql_snap(_sql_paired(x, y, n, sql_pair_corr(x, y, sql_over(n)))), (2,), lambda n: n - 1),
    "CORR2": Op("time", lambda x, y, n: snap(_paired(x, y, n, pair_corr(x, y, over(n)), 2)), lambda x, y, n: sql_snap(_sql_paired(x, y, n, sql_pair_corr(x, y, sql_over(n)), 2)), (2,), lambda n: n - 1),
    "COV": Op("time", lambda x, y, n: snap(_paired(x, y, n, F.covar_samp(x, y).over(over(n)))), lambda x, y, n: sql_snap(_sql_paired(x, y, n, f"covar_samp({x}, {y}) {sql_over(n)}")), (2,), lambda n: n - 1),
    "REGBETA": Op("time", _beta, _sql_beta, (2,), lambda n: n - 1),
    "REGRESI": Op("time", lambda y, x, n: snap(y - F.avg(y).over(over(n)) - _beta(y, x, n) * (x - F.avg(x).over(over(n)))), lambda y, x, n: sql_snap(f"({y} - avg({y}) {sql_over(n)} - ({_sql_beta(y, x, n)}) * ({x} - avg({x}) {sql_over(n)}))"), (2,), lambda n: n - 1),
    "SLOPE": _fit("slope"), "RSQUARE": _fit("r2"), "RESIDUAL": _fit("rest"),
    "SMA": Op("time", lambda x, n, m: snap(_sma(x, n, m)), lambda x, n, m: sql_snap(_sql_sma(x, n, m)), (1, 2), lambda n, m: _sma_rows(n, m) - 1),
    "COUNT": Op("time", lambda c, n: full(n, c, F.sum(F.when(c > 0, 1.0).otherwise(0.0)).over(over(n))), lambda c, n: sql_full(n, c, f"sum(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END) {sql_over(n)}"), (1,), lambda n: n - 1),
    "SUMIF": Op("time", lambda x, c, n: snap(full(n, x, F.sum(F.when(c > 0, x).otherwise(0.0)).over(over(n)))), lambda x, c, n: sql_snap(sql_full(n, x, f"sum(CASE WHEN {c} > 0 THEN {x} ELSE 0.0 END) {sql_over(n)}")), (2,), lambda n: n - 1),
    "SUMAC": Op("time", lambda x: F.when(x.isNotNull(), F.sum(x).over(over(None))), lambda x: f"CASE WHEN {x} IS NOT NULL THEN sum({x}) {sql_over(None)} END"),
    "CUMMAX": Op("time", lambda x: F.max(x).over(over(None)), lambda x: f"max({x}) {sql_over(None)}"),
    "CUMPROD": Op("time", lambda x: snap(F.product(x).over(over(None))), lambda x: sql_snap(f"product({x}) {sql_over(None)}")),
    "QUANTILE": Op("time", lambda x, n, p: snap(full(n, x, F.percentile(x, F.lit(p)).over(over(n)))), lambda x, n, p: sql_snap(sql_full(n, x, f"quantile_cont({x}, {p}) {sql_over(n)}")), (1, 2), lambda n, p: n - 1),
    "ROWS": Op("time", lambda x, n: F.when(F.count(F.lit(1)).over(over(n)) == n, x), lambda x, n: f"CASE WHEN count(*) {sql_over(n)} = {n} THEN {x} END", (1,), lambda n: n - 1),
    "OLDSLOPE": Op("time", lambda y, x, n: snap(F.when(F.var_pop(x).over(over(n, 1)) > 1e-18, F.try_divide(F.covar_pop(x, y).over(over(n, 1)), F.var_pop(x).over(over(n, 1))))), lambda y, x, n: sql_snap(f"CASE WHEN var_pop({x}) {sql_over(n, 1)} > 1e-18 THEN covar_pop({x}, {y}) {sql_over(n, 1)} / (var_pop({x}) {sql_over(n, 1)}) END"), (2,), lambda n: n),
    "LASTZ": Op("time", lambda x, n, k: snap(F.when((F.count(x).over(over(n)) >= k) & (F.stddev_samp(x).over(over(n)) > 1e-12), F.try_divide(x - F.avg(x).over(over(n)), F.stddev_samp(x).over(over(n))))), lambda x, n, k: sql_snap(f"CASE WHEN count({x}) {sql_over(n)} >= {k} AND stddev_samp({x}) {sql_over(n)} > 1e-12 THEN ({x} - avg({x}) {sql_over(n)}) / (stddev_samp({x}) {sql_over(n)}) END"), (1, 2), lambda n, k: n - 1),
    "RANK": Op("cross", lambda x: percent_rank(x, ["date"]), lambda x: sql_percent_rank(x, "date")),
    "RANKAVG": Op("cross", lambda x: average_rank(x, ["date"]), lambda x: sql_average_rank(x, "date")),
    "SCALE": Op("cross", lambda x, k=1.0: snap(_scale(x, k)), lambda x, k=1.0: sql_snap(f"CASE WHEN sum(abs({x})) {_BY_DATE} > 0 THEN {x} / sum(abs({x})) {_BY_DATE} * {k} ELSE {x} * 0.0 END"), (1,)),
    "NEUT": Op("cross", lambda x, g: snap(F.when(g.isNotNull(), x - F.avg(x).over(Window.partitionBy("date", g)))), lambda x, g: sql_snap(f"CASE WHEN {g} IS NOT NULL THEN {x} - avg({x}) OVER (PARTITION BY date, {g}) END")),
    "XMEAN": Op("cross", lambda x: snap(F.avg(x).over(Window.partitionBy("date"))), lambda x: sql_snap(f"avg({x}) {_BY_DATE}")),
    "ZSCORE": Op("cross", lambda x: snap(F.when(F.stddev_pop(x).over(Window.partitionBy("date")) > 1e-12, F.try_divide(x - F.avg(x).over(Window.partitionBy("date")), F.stddev_pop(x).over(Window.partitionBy("date")))).otherwise(x * 0.0)), lambda x: sql_snap(f"CASE WHEN stddev_pop({x}) {_BY_DATE} > 1e-12 THEN ({x} - avg({x}) {_BY_DATE}) / (stddev_pop({x}) {_BY_DATE}) ELSE {x} * 0.0 END")),
    "WINSOR": Op("cross", lambda x, p: snap(F.when(x.isNotNull(), F.greatest(F.least(x, F.percentile(x, F.lit(1 - p)).over(Window.partitionBy("date"))), F.percentile(x, F.lit(p)).over(Window.partitionBy("date"))))), lambda x, p: sql_snap(f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, quantile_cont({x}, {1 - p}) {_BY_DATE}), quantile_cont({x}, {p}) {_BY_DATE}) END"), (1,)),
}
