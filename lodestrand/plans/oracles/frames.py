"""The frames that evaluation stands on, in SQL of their own: named table expressions and what each needs."""

from __future__ import annotations

from lodestrand.plans.layers import sql_rounded
from lodestrand.sources.panel import BRAND_WEEK_SQL

_CODE = "OVER (PARTITION BY code ORDER BY date)"
_FOUR = "OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"

#: The factors of the evaluation queries, in this order, and horizons of decay in rows.
FACTORS = ("mom", "rev", "liq", "rng")
HORIZONS = (1, 3, 5, 10, 20)


def place(x: str, by: str) -> str:
    """The average rank of x in its group: how many are less, and half of those equal, itself too."""
    rows = f"list({x}) OVER (PARTITION BY {by})"
    return f"(len(list_filter({rows}, lambda v: v < {x})) + (len(list_filter({rows}, lambda v: v = {x})) + 1) / 2.0)"


def corr(x: str, y: str) -> str:
    """Pearson over the pairs of a group, NULL where a side doesn't move."""
    pair = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"CASE WHEN max({x}) {pair} - min({x}) {pair} > 1e-9 AND max({y}) {pair} - min({y}) {pair} > 1e-9 THEN corr({x}, {y}) END"


r = sql_rounded

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "panel": ((), BRAND_WEEK_SQL),
    "factor": (
        ("panel",),
        f"""SELECT date, code, {r(f'(close / lag(close, 4) {_CODE} - 1)')} AS mom, {r(f'(1 - close / lag(close) {_CODE})')} AS rev,
          {r(f'(CASE WHEN count(volume) {_FOUR} = 4 THEN volume / avg(volume) {_FOUR} - 1 END)')} AS liq,
          {r(f'(CASE WHEN count(close) {_FOUR} = 4 THEN avg((high - low) / close) {_FOUR} END)')} AS rng,
          {r(f'(lead(close) {_CODE} / close - 1)')} AS fwd FROM panel""",
    ),
    "long": (("factor",), " UNION ALL ".join(f"SELECT date, code, '{f}' AS factor, {f} AS value, fwd FROM factor" for f in FACTORS)),
    "pairs": (("long",), "SELECT * FROM long WHERE value IS NOT NULL AND fwd IS NOT NULL"),
    "ranked": (("pairs",), f"SELECT date, factor, value, fwd, {place('value', 'date, factor')} AS rv, {place('fwd', 'date, factor')} AS rf FROM pairs"),
    "ic": (("ranked",), f"SELECT date, factor, {r(corr('rv', 'rf'))} AS ic, {r(corr('value', 'fwd'))} AS pearson, count(*) AS n FROM ranked GROUP BY date, factor"),
    "ic5": (("ic",), "SELECT * FROM ic WHERE n >= 5 AND ic IS NOT NULL"),
    "tests": (("ic5",), "SELECT factor, count(*) AS days, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) AS t FROM ic5 GROUP BY factor"),
    "bucket": (
        ("pairs",),
        """SELECT date, code, factor, value, fwd, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((k - 1) * 5.0 / (n - 1))) END AS INT) AS bucket
          FROM (SELECT *, row_number() OVER (PARTITION BY date, factor ORDER BY value, code) AS k, count(*) OVER (PARTITION BY date, factor) AS n FROM pairs)""",
    ),
    "legs": (("bucket",), f"SELECT date, factor, {r('(avg(fwd) FILTER (bucket = 5) - avg(fwd) FILTER (bucket = 1))', 8)} AS r FROM bucket GROUP BY date, factor HAVING count(*) FILTER (bucket = 5) > 0 AND count(*) FILTER (bucket = 1) > 0"),
    "days": (("panel",), "SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM panel)"),
    "basket": (
        ("long", "days"),
        "SELECT factor, day, date, code FROM (SELECT l.*, d.day, rank() OVER (PARTITION BY l.factor, l.date ORDER BY value DESC) AS k, count(*) OVER (PARTITION BY l.factor, l.date) AS n FROM long l JOIN days d USING (date) WHERE value IS NOT NULL) WHERE k <= 0.2 * n",
    ),
    "truth": (
        ("factor",),
        """SELECT date, code, mom AS submitted, CASE WHEN (CAST(substr(code, 7) AS INT) + month(date) * 31 + day(date)) % 50 = 0 THEN mom * 1.5 + 0.001
          WHEN (CAST(substr(code, 7) AS INT) + day(date)) % 41 = 0 THEN NULL ELSE mom END AS truth FROM factor""",
    ),
    "nav": (
        ("panel",),
        f"""SELECT strategy, date, {r('nav', 8)} AS nav, {r('avg(nav) OVER (PARTITION BY date)', 8)} AS benchmark
          FROM (SELECT code AS strategy, date, close / first(close) OVER (PARTITION BY code ORDER BY date) AS nav FROM panel)""",
    ),
    "returns": (
        ("nav",),
        """SELECT strategy, date, nav, benchmark, nav / lag(nav) OVER w - 1 AS r, benchmark / lag(benchmark) OVER w - 1 AS b FROM nav WINDOW w AS (PARTITION BY strategy ORDER BY date)""",
    ),
    "peaks": (("nav",), "SELECT strategy, date, nav, max(nav) OVER (PARTITION BY strategy ORDER BY date) AS peak FROM nav"),
}


def query(select: str, *needs: str, **own: str) -> str:
    """A statement over the frames named, with further table expressions of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                add(other)
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in order] + [f"{name} AS ({text})" for name, text in own.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select
