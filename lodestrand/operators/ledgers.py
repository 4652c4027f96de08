"""Ledgers and engines: positions, sleeves, execution of target weights, rotation, breakouts, tuning.

All are sorted folds; missing prices and quantities count as 0 and change nothing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.folds import sorted_fold


def _by_date(rows: Iterator[tuple], at: int) -> Iterator[tuple]:
    for date, day in groupby(rows, key=lambda r: r[at]):
        yield date, list(day)


def position_ledger(trades: DataFrame) -> DataFrame:
    """(account, code, quantity, cost, realized) after all trades (account, code, time, seq, side, qty, price, fee) of each (account, code),
    in their order: average cost with fees, sales no larger than what is held, profit realized against it less the sale's fee."""
    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        quantity = cost = realized = 0.0
        for _, _, _, _, side, q, price, fee in rows:
            q, price, fee = q or 0.0, price or 0.0, fee or 0.0
            if side == "BUY":
                cost = (cost * quantity + q * price + fee) / (quantity + q) if quantity + q else 0.0
                quantity += q
            else:
                sold = min(q, quantity)
                realized += sold * (price - cost) - fee
                quantity -= sold
        yield (*key, quantity, cost, realized)

    kinds = dict(trades.dtypes)
    own = trades.select("account", "code", "time", "seq", "side", "qty", "price", "fee")
    return sorted_fold(own, ["account", "code"], ["time", "seq"], fold, f"account {kinds['account']}, code {kinds['code']}, quantity double, cost double, realized double")


def account_equity(ledger: DataFrame, trades: DataFrame, last: DataFrame, cash: float = 10_000.0) -> DataFrame:
    """(account, cash, holdings, equity): what trades left of the cash, what positions are worth at the ``last`` prices (code, price), and both."""
    side = F.when(F.col("side") == "BUY", -1).otherwise(1)
    moved = trades.groupBy("account").agg((F.sum(side * F.col("qty") * F.col("price")) - F.sum("fee") + cash).alias("cash"))
    held = ledger.join(last, "code", "left").groupBy("account").agg(F.sum(F.col("quantity") * F.coalesce("price", F.lit(0.0))).alias("holdings"))
    return moved.join(held, "account", "left").select("account", "cash", F.coalesce("holdings", F.lit(0.0)).alias("holdings"), (F.col("cash") + F.coalesce("holdings", F.lit(0.0))).alias("equity"))


def period_key(every: str):
    """What two dates share if no rebalance lies between them."""
    keys = {"daily": lambda d: d, "weekly": lambda d: d.isocalendar()[:2], "monthly": lambda d: (d.year, d.month), "quarterly": lambda d: (d.year, (d.month - 1) // 3)}
    if every not in keys:
        raise ValueError(f"no such frequency: {every}")
    return keys[every]


def sleeve_ledger(navs: DataFrame, every: str = "monthly", cash: float = 1_000_000.0, cost: float = 0.0008) -> DataFrame:
    """(portfolio, date, nav, benchmark, drawdown, cash, traded, paid) of portfolios of sleeves (portfolio, sleeve, weight, date, nav, benchmark).

    Sleeves are bought and sold at their NAV out of one cash account, on the first date and whenever a period begins: first what is over
    its weight is sold, then what is under is bought with the cash there is after costs, in the sleeves' order. Only dates that all
    sleeves have count. ``traded`` and ``paid`` are the day's notional and costs."""
    key_of = period_key(every)
    n = navs.groupBy("portfolio").agg(F.count_distinct("sleeve").alias("sleeves"))
    days = navs.groupBy("portfolio", "date").agg(F.count_distinct("sleeve").alias("there")).join(n, "portfolio").filter("there = sleeves").select("portfolio", "date")
    own = navs.join(days, ["portfolio", "date"]).select("portfolio", "date", "sleeve", "weight", "nav", "benchmark")

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        money, peak, last, first = cash, cash, None, {}
        units: dict = {}
        for date, day in _by_date(rows, 1):
            price = {r[2]: r[4] for r in day}
            weight = {r[2]: r[3] for r in day}
            traded = paid = 0.0
            worth = lambda: money + sum(u * price[s] for s, u in units.items())
            if last is None or key_of(date) != last:
                total = worth()
                gaps = {s: total * w - units.get(s, 0.0) * price[s] for s, w in weight.items()}
                for sign in (-1, 1):
                    for s, gap in gaps.items():
                        if gap * sign <= 0:
                            continue
                        size = abs(gap) if sign < 0 else min(gap, max(money, 0.0) / (1 + cost))
                        units[s] = units.get(s, 0.0) + sign * size / price[s]
                        money -= sign * size + size * cost
                        traded, paid = traded + size, paid + size * cost
                last = key_of(date)
            equity = worth()
            peak = max(peak, equity)
            for r in day:
                first.setdefault(r[2], r[5] or 1.0)
            market = sum(r[3] * (r[5] or first[r[2]]) / first[r[2]] for r in day)
            yield (*key, date, equity / cash, market, equity / peak - 1, money, traded, paid)

    kind = dict(navs.dtypes)["portfolio"]
    return sorted_fold(own, ["portfolio"], ["date", "sleeve"], fold, f"portfolio {kind}, date date, nav double, benchmark double, drawdown double, cash double, traded double, paid double")


# Prefixes of codes, smallest order, step and largest order of their boards; the last is for all others.
BOARDS = (("688", 200, 1, 100_000), ("4", 100, 1, 1_000_000), ("8", 100, 1, 1_000_000), ("300", 100, 100, 300_000), ("301", 100, 100, 300_000), ("", 100, 100, 1_000_000))


def lot(code: str, shares: float) -> int:
    """Whole shares that the code's board lets one order have."""
    _, least, step, most = next(b for b in BOARDS if code.startswith(b[0]))
    n = int(shares)
    return 0 if n < least else min(n // step * step, most)


def lots(code, shares):
    """As :func:`lot`, as a column expression."""
    n = F.floor(shares)
    out = None
    for prefix, least, step, most in BOARDS:
        own = F.when(n < least, F.lit(0)).otherwise(F.least(F.floor(n / step) * step, F.lit(most)))
        out = F.when(code.startswith(prefix), own) if out is None else out.when(code.startswith(prefix), own) if prefix else out.otherwise(own)
    return out.cast("long")


@dataclass(frozen=True)
class Costs:
    commission: float = 0.0003
    least: float = 5.0
    stamp: float = 0.001
    slippage: float = 0.001

    def fee(self, amount: float, sells: bool) -> float:
        return round(max(round(amount * self.commission, 2), self.least) + (round(amount * self.stamp, 2) if sells else 0.0), 2)


def execute_targets(bars: DataFrame, signals: DataFrame, cash: float = 1_000_000.0, costs: Costs = Costs(), start: str | None = None) -> DataFrame:
    """(strategy, date, kind, code, side, qty, price, amount, fee, value): trades and daily values of strategies that follow target weights.

    ``bars`` (date, code, close) are those of the market, ``signals`` (strategy, date, code, weight). On a date with signals, what isn't among
    them is sold first; then, cheapest code first, each code is brought to the lots that its weight of the value buys at the close with
    slippage. A purchase whose whole cost is over 98 % of the cash at that moment is left out. Fills are at the close, less fees.
    On other dates positions stay. Rows of kind "trade" are orders filled, rows of kind "nav" have the value at the close of each date;
    a code without a bar keeps its last close and isn't traded. Only bars of codes that a strategy ever names reach it."""
    codes = signals.select("strategy", "code").distinct()
    days = signals.select("strategy", "date").distinct().withColumn("called", F.lit(True))
    named = bars.select("date", "code", "close").join(codes, "code")
    every = named.join(signals.select("strategy", "date", "code", "weight"), ["strategy", "date", "code"], "left").join(days, ["strategy", "date"], "left")
    own = every.select("strategy", "date", "code", "close", "weight", F.coalesce("called", F.lit(False)).alias("called"))
    if start:
        own = own.filter(F.col("date") >= F.lit(start).cast("date"))

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        money, held, last = cash, {}, {}
        for date, day in _by_date(rows, 1):
            close = {r[2]: r[3] for r in day if r[3] and r[3] > 0}
            last.update(close)
            if any(r[5] for r in day):
                total = money + sum(q * last[c] for c, q in held.items())
                wanted = {r[2]: r[4] for r in day if r[4] is not None}
                orders = [(c, -q) for c, q in sorted(held.items()) if c not in wanted and c in close]
                for c, w in sorted(wanted.items(), key=lambda x: (close.get(x[0], 0.0), x[0])):
                    if c in close:
                        target = lot(c, total * w / (close[c] * (1 + costs.slippage)))
                        orders.append((c, target - held.get(c, 0)))
                for c, change in orders:
                    if not change:
                        continue
                    amount = round(close[c] * abs(change), 2)
                    fee = costs.fee(amount, change < 0)
                    if change > 0 and (held.get(c, 0) + change) * close[c] * (1 + costs.slippage) * (1 + costs.commission) > 0.98 * money:
                        continue
                    money -= (amount if change > 0 else -amount) + fee
                    held[c] = held.get(c, 0) + change
                    if not held[c]:
                        del held[c]
                    yield (*key, date, "trade", c, "buy" if change > 0 else "sell", abs(change), close[c], amount, fee, None)
            yield (*key, date, "nav", None, None, None, None, None, None, money + sum(q * last[c] for c, q in held.items()))

    kind = dict(signals.dtypes)["strategy"]
    return sorted_fold(own, ["strategy"], ["date", "code"], fold, f"strategy {kind}, date date, kind string, code string, side string, qty long, price double, amount double, fee double, value double")


def filled_weights(ranked: Iterable[tuple[str, str]], budget: float, base: float = 0.10, most: float = 0.20, sector: float = 0.30, size: int = 10, allowed: frozenset[str] | None = None) -> dict[str, float]:
    """Weights of codes (code, sector) in order of their scores: each takes ``base`` while its sector has room, ``size`` codes at most;
    scaled down to the budget, or what is left of the budget poured over them in equal parts, 50 times at most, up to
    ``most`` a code and ``sector`` a sector."""
    if budget <= 0:
        return {}
    chosen: dict[str, str] = {}
    used: dict[str, float] = {}
    for code, group in ranked:
        if allowed is not None and group not in allowed or used.get(group, 0.0) + base > sector + 1e-9:
            continue
        chosen[code] = group
        used[group] = used.get(group, 0.0) + base
        if len(chosen) >= size:
            break
    weights = {c: base for c in chosen}
    total = base * len(weights)
    if total > budget + 1e-9:
        return {c: w * budget / total for c, w in weights.items()}
    left = budget - total
    for _ in range(50):
        if left <= 1e-8:
            break
        room = {c: min(most - weights[c], sector - sum(w for x, w in weights.items() if chosen[x] == g)) for c, g in chosen.items()}
        room = {c: r for c, r in room.items() if r > 1e-12}
        if not room:
            break
        part, poured = left / len(room), 0.0
        for c, r in room.items():
            weights[c] += min(part, r)
            poured += min(part, r)
        left -= poured
        if poured <= 1e-12:
            break
    return weights


def rotation_weights(scores: DataFrame, budget: float = 1.0) -> DataFrame:
    """(date, code, weight) by :func:`filled_weights` of the codes of each date (date, code, sector, score), best score first, ties by code."""
    own = scores.filter("score IS NOT NULL").select("date", (-F.col("score")).alias("against"), "code", "sector")

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for code, weight in filled_weights([(r[2], r[3]) for r in rows], budget).items():
            yield (*key, code, weight)

    return sorted_fold(own, ["date"], ["against", "code"], fold, "date date, code string, weight double")


@dataclass(frozen=True)
class Rotation:
    """How a rotation reacts. ``defensive`` are the sectors that stay when the market is down."""

    alert: float = 0.05
    alert2: float = 0.07
    stop: float = 0.09
    risk_full: float = 1.0
    risk_alert: float = 0.5
    risk_alert2: float = 0.25
    risk_stop: float = 0.0
    bear_budget: float = 0.30
    crash_budget: float = 0.20
    defensive: tuple[str, ...] = ()
    crash_ret1: float = -0.03
    crash_ret5: float = -0.06
    cost: float = 0.0008

    def budget(self, drawdown: float) -> float:
        return self.risk_stop if drawdown >= self.stop else self.risk_alert2 if drawdown >= self.alert2 else self.risk_alert if drawdown >= self.alert else self.risk_full


def regime(ret1, ret5, close, ma20, ma60, rules: Rotation = Rotation(), rsrs=None):
    """"CRASH", "BEAR" or "BULL" of a market, as a column expression: falls first, then RSRS if it is given and clear, then the means."""
    out = F.when((ret1 <= rules.crash_ret1) | (ret5 <= rules.crash_ret5), "CRASH")
    if rsrs is not None:
        out = out.when(rsrs > 0.7, "BULL").when(rsrs < -0.7, "BEAR")
    return out.when((close < ma60) | (close < ma20), "BEAR").otherwise("BULL")


def rotate(days: DataFrame, rules: Mapping[str, Rotation]) -> DataFrame:
    """(run, date, equity, drawdown, turnover, cost, regime, names) of each rule set of ``rules`` over ``days`` (date, regime, code, sector, score, ret).

    ``regime`` and ``score`` are those of the day before, ``ret`` is the day's return of each code. The risk budget depends on the drawdown so
    far, so days come one after the other; runs are apart. What turns over is paid before the day's return. ``score`` is NULL for what
    isn't eligible."""
    names = days.sparkSession.createDataFrame([(k,) for k in rules], "run string")
    own = days.join(F.broadcast(names)).select("run", "date", (-F.col("score")).alias("against"), "code", "sector", "ret", "regime")
    held = dict(rules)

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        p = held[key[0]]
        equity = peak = 1.0
        before: dict[str, float] = {}
        for date, day in _by_date(rows, 1):
            state = day[0][6]
            budget, allowed = p.budget((peak - equity) / peak), None
            if state in ("BEAR", "CRASH"):
                budget, allowed = min(budget, p.bear_budget if state == "BEAR" else min(p.bear_budget, p.crash_budget)), frozenset(p.defensive)
            weights = filled_weights([(r[3], r[4]) for r in day if r[2] is not None], budget, allowed=allowed)
            turnover = sum(abs(weights.get(c, 0.0) - before.get(c, 0.0)) for c in sorted({*weights, *before}))
            paid = equity * turnover * p.cost
            gain = {r[3]: r[5] or 0.0 for r in day}
            equity = max(0.0, equity - paid) * (1 + sum(w * gain.get(c, 0.0) for c, w in weights.items()))
            peak = max(peak, equity)
            yield (*key, date, equity, (peak - equity) / peak, turnover, paid, state, len(weights))
            before = weights

    return sorted_fold(own, ["run"], ["date", "against", "code"], fold, "run string, date date, equity double, drawdown double, turnover double, cost double, regime string, names int")


def tuned(days: DataFrame, grid: Mapping[str, Iterable[float]], base: Rotation = Rotation(), periods: int = 252, deepest: float = 0.10) -> DataFrame:
    """(run, parameters, annual, sharpe, max_drawdown, turnover, feasible, score, place) of every combination of the values in ``grid``:
    score = sharpe + 0.6 annual - 0.15 turnover - 2 max(0, 0.3 - annual); a combination whose drawdown is deeper than ``deepest`` isn't feasible
    and comes after all that are. Each combination is a run of :func:`rotate`, all at once."""
    from itertools import product

    names = list(grid)
    sets = [dict(zip(names, values)) for values in product(*grid.values())]
    rules = {f"run{k:04d}": replace(base, **s) for k, s in enumerate(sets)}
    told = days.sparkSession.createDataFrame([(f"run{k:04d}", ",".join(f"{n}={v}" for n, v in s.items())) for k, s in enumerate(sets)], "run string, parameters string")
    from pyspark.sql.window import Window

    curve = rotate(days, rules).withColumn("r", F.try_divide("equity", F.lag("equity").over(Window.partitionBy("run").orderBy("date"))) - 1)
    g = curve.groupBy("run").agg(F.min_by("equity", "date").alias("e0"), F.max_by("equity", "date").alias("e1"), F.count("*").alias("n"), F.avg(F.coalesce("r", F.lit(0.0))).alias("m"), F.stddev_pop(F.coalesce("r", F.lit(0.0))).alias("s"), F.max("drawdown").alias("max_drawdown"), F.avg("turnover").alias("turnover"))
    annual = F.when(F.col("e0") > 0, F.pow(F.col("e1") / F.col("e0"), F.lit(float(periods)) / F.col("n")) - 1).otherwise(0.0)
    sharpe = F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * float(periods) ** 0.5).otherwise(0.0)
    scored = g.select("run", annual.alias("annual"), sharpe.alias("sharpe"), "max_drawdown", "turnover").withColumn("feasible", F.col("max_drawdown") <= deepest)
    scored = scored.withColumn("score", F.col("sharpe") + 0.6 * F.col("annual") - 0.15 * F.col("turnover") - 2.0 * F.greatest(F.lit(0.0), 0.30 - F.col("annual")))
    place = F.row_number().over(Window.orderBy(F.desc("feasible"), F.desc("score"), "run"))
    return scored.join(F.broadcast(told), "run").select("run", "parameters", "annual", "sharpe", "max_drawdown", "turnover", "feasible", "score", place.cast("long").alias("place"))


def breakout_machine(bars: DataFrame, cooldown: int = 54, look: int = 9, level: float = 45.0, stop: float = 0.008, trail: float = 0.01) -> DataFrame:
    """(code, date, action, price, reason) of a long and short breakout on bars (code, date, high, low, close, rsi, wr).

    Flat: BUY when rsi > 65, wr crosses ``level`` upwards and was above it within the ``look`` bars before; SELL the other way round (rsi < 35,
    -``level``); each side waits ``cooldown`` bars after its last entry. In a position: out when the close is beyond the stop from the entry
    or the trail from the best high (low) since. Bars without rsi or wr only move the position's best price."""
    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        side, entry, best, before, past = 0, 0.0, 0.0, None, []
        last = {1: -(10**9), -1: -(10**9)}
        for k, (_, date, high, low, close, rsi, wr) in enumerate(rows):
            if side:
                best = max(best, high) if side > 0 else min(best, low)
                stopped = side * close <= side * entry * (1 - side * stop)
                trailed = side * close <= side * best * (1 - side * trail)
                if stopped or trailed:
                    yield (*key, date, "CLOSE_LONG" if side > 0 else "CLOSE_SHORT", close, "stop" if stopped else "trail")
                    side = 0
            elif rsi is not None and wr is not None and before is not None:
                for way in (1, -1):
                    crosses = way * wr > level and way * before <= level
                    if way * (rsi - 50) > 15 and crosses and any(way * x > level for x in past if x is not None) and k - last[way] > cooldown:
                        side, entry, best, last[way] = way, close, close, k
                        yield (*key, date, "BUY" if way > 0 else "SELL", close, "breakout")
                        break
            before = wr
            past = [*past, wr][-look:]

    kind = dict(bars.dtypes)["code"]
    return sorted_fold(bars.select("code", "date", "high", "low", "close", "rsi", "wr"), ["code"], ["date"], fold, f"code {kind}, date date, action string, price double, reason string")
