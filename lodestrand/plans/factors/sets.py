"""The other factor sets, as formulas or by rules that make them."""

from __future__ import annotations

from lodestrand.plans.factors import alpha101

WINDOWS = (5, 10, 20, 30, 60)
_EPS = "0.000000000001"


def alpha158(windows: tuple[int, ...] = WINDOWS) -> dict[str, str]:
    """Candle shapes, price ratios and 29 features for each window."""
    e = _EPS
    out = {
        "KMID": "(close - open) / open", "KLEN": "(high - low) / open", "KMID2": f"(close - open) / (high - low + {e})",
        "KUP": "(high - GREATEST(open, close)) / open", "KUP2": f"(high - GREATEST(open, close)) / (high - low + {e})",
        "KLOW": "(LEAST(open, close) - low) / open", "KLOW2": f"(LEAST(open, close) - low) / (high - low + {e})",
        "KSFT": "(2 * close - high - low) / open", "KSFT2": f"(2 * close - high - low) / (high - low + {e})",
        "OPEN0": "open / close", "HIGH0": "high / close", "LOW0": "low / close", "VWAP0": "COALESCE(amount / volume, close) / close",
    }
    up, down = "GREATEST({0} - DELAY({0}, 1), 0)", "GREATEST(DELAY({0}, 1) - {0}, 0)"
    move = "ABS(close / DELAY(close, 1) - 1) * volume"
    for d in windows:
        def sums(x: str, name: str) -> dict[str, str]:
            gain, loss, all_ = (f"SUM({y.format(x)}, {d})" for y in (up, down, "ABS({0} - DELAY({0}, 1))"))
            return {f"{name}P{d}": f"{gain} / ({all_} + {e})", f"{name}N{d}": f"{loss} / ({all_} + {e})", f"{name}D{d}": f"({gain} - {loss}) / ({all_} + {e})"}

        higher, lower = f"MEAN(close > DELAY(close, 1), {d})", f"MEAN(close < DELAY(close, 1), {d})"
        out |= {
            f"ROC{d}": f"DELAY(close, {d}) / close", f"MA{d}": f"MEAN(close, {d}) / close", f"STD{d}": f"STD1(close, {d}) / close",
            f"BETA{d}": f"SLOPE(close, {d}) / close", f"RSQR{d}": f"RSQUARE(close, {d})", f"RESI{d}": f"RESIDUAL(close, {d}) / close",
            f"MAX{d}": f"TSMAX(high, {d}) / close", f"MIN{d}": f"TSMIN(low, {d}) / close", f"QTLU{d}": f"QUANTILE(close, {d}, 0.8) / close", f"QTLD{d}": f"QUANTILE(close, {d}, 0.2) / close",
            f"RANK{d}": f"TSRANK(close, {d})", f"RSV{d}": f"(close - TSMIN(low, {d})) / (TSMAX(high, {d}) - TSMIN(low, {d}) + {e})",
            f"IMAX{d}": f"ARGMAX(high, {d}) / {d}", f"IMIN{d}": f"ARGMIN(low, {d}) / {d}", f"IMXD{d}": f"(ARGMAX(high, {d}) - ARGMIN(low, {d})) / {d}",
            f"CORR{d}": f"ROWS(CORR2(close, LOG(volume + 1), {d}), {d})", f"CORD{d}": f"ROWS(CORR2(close / DELAY(close, 1), LOG(volume / DELAY(volume, 1) + 1), {d}), {d})",
            f"CNTP{d}": higher, f"CNTN{d}": lower, f"CNTD{d}": f"{higher} - {lower}",
            **sums("close", "SUM"), f"VMA{d}": f"MEAN(volume, {d}) / (volume + {e})", f"VSTD{d}": f"STD1(volume, {d}) / (volume + {e})",
            f"WVMA{d}": f"STD1({move}, {d}) / (MEAN({move}, {d}) + {e})", **sums("volume", "VSUM"),
        }
    return out


def gtja191() -> dict[str, str]:
    """The ten that are defined of 191; any other name is an error."""
    mid = "(high + low) / 2"
    return {
        "alpha1": "-1 * CORR(RANK(DELTA(LOG(volume), 1)), RANK((close - open) / open), 6)",
        "alpha2": "-1 * DELTA(((close - low) - (high - close)) / (high - low), 1)",
        "alpha3": "SUM((close > DELAY(close, 1)) ? close - LEAST(low, DELAY(close, 1)) : ((close < DELAY(close, 1)) ? close - GREATEST(high, DELAY(close, 1)) : 0), 6)",
        "alpha4": "(MEAN(close, 8) + STD1(close, 8) < MEAN(close, 2)) ? -1 : ((MEAN(close, 2) < MEAN(close, 8) - STD1(close, 8)) ? 1 : ((volume / MEAN(volume, 20) >= 1) ? 1 : -1))",
        "alpha5": "-1 * TSMAX(CORR(TSRANK(volume, 5), TSRANK(high, 5), 5), 3)",
        "alpha6": "-1 * RANK(SIGN(DELTA(open * 0.85 + high * 0.15, 4)))",
        "alpha7": "(RANK(TSMAX(vwap - close, 3)) + RANK(TSMIN(vwap - close, 3))) * RANK(DELTA(volume, 3))",
        "alpha8": f"RANK(-1 * DELTA({mid} * 0.2 + vwap * 0.8, 4))",
        "alpha9": f"SMA(({mid} - DELAY({mid}, 1)) * (high - low) / volume, 7, 2)",
        "alpha10": "RANK(TSMAX(((returns < 0) ? STD1(returns, 20) : close) ^ 2, 5))",
    }


def quant33() -> dict[str, str]:
    """Momentum, risk, liquidity and ratio factors on months of 21 rows."""
    gain, loss = "MEAN(GREATEST(close - DELAY(close, 1), 0), 14)", "MEAN(GREATEST(DELAY(close, 1) - close, 0), 14)"
    mid, band = "MEAN(close, 20)", "STD(close, 20)"
    prices = {
        "ret_1m": "RET(close, 21)", "ret_3m": "RET(close, 63)", "ret_6m": "RET(close, 126)", "ret_12m": "RET(close, 252)",
        "volatility_1m": "STD(returns, 21)", "volatility_3m": "STD(returns, 63)", "volatility_6m": "STD(returns, 126)", "reversal": "-1 * RET(close, 21)",
        "momentum_12_1": "DELAY(close, 21) / DELAY(close, 252) - 1", "avg_amount_1m": "MEAN(amount, 21)", "log_amount_1m": "LOG(MEAN(amount, 21))",
        "max_ret_1m": "TSMAX(returns, 21)", "min_ret_1m": "TSMIN(returns, 21)", "up_ratio_1m": "MEAN(returns > 0, 21)", "ma_signal": "close / MEAN(close, 20) - 1",
        "vol_convergence": "STD(returns, 21) / STD(returns, 63)", "illiquidity": "MEAN(ABS(returns) / amount * 1000000, 21) / 1000000", "log_price": "LOG(close)",
        "turnover_proxy": "volume / MEAN(volume, 252)", "volume_ratio": "MEAN(volume, 5) / MEAN(volume, 21)", "high_low_1m": "TSMAX(high, 21) / TSMIN(low, 21) - 1",
        "rsi_14": f"IF({loss} == 0, IF({gain} > 0, 100, 50 + 0 * {gain}), 100 - 100 / (1 + {gain} / {loss}))",
        "bb_position": f"(close - ({mid} - 2 * {band})) / (4 * {band})", "ret_3m_vol_adj": "RET(close, 63) / STD(returns, 63)", "amplitude_1m": "MEAN((high - low) / close, 21)",
    }
    ratios = {"roe_ttm": "net_profit_ttm / equity", "roa_ttm": "net_profit_ttm / assets", "net_margin": "net_profit_ttm / revenue_ttm", "debt_to_asset": "liabilities / assets", "asset_turnover": "revenue_ttm / assets", "revenue_yoy": "revenue_yoy", "profit_yoy": "profit_yoy", "eps_yoy": "eps_yoy"}
    return prices | ratios


#: What the ratio factors read; panels without a column have NULL there.
FUNDAMENTALS = ["net_profit_ttm", "equity", "assets", "revenue_ttm", "liabilities", "revenue_yoy", "profit_yoy", "eps_yoy"]


def barra(market: str = "XMEAN(returns)") -> dict[str, str]:
    """Style factors. ``market`` is the market's return: the equal-weighted mean of the date by default.
    The non-linear size is a residual over the whole panel; see :mod:`lodestrand.operators.evaluation`."""
    return {
        "size": "LOG(close * total_shares)", "beta": f"REGBETA(returns, {market}, 60)", "momentum_12m1m": "DELAY(close, 21) / DELAY(close, 252) - 1", "volatility": "STD1(returns, 60)",
        "btop": "book_value_per_share / close", "earnings_yield": "eps_ttm / close", "growth": "net_profit_yoy", "leverage": "debt_to_equity",
        "liquidity": "LOG(MEAN(volume / close, 20))", "residual_volatility": f"STD1(returns - REGBETA(returns, {market}, 60) * {market}, 60)",
    }


BARRA_INPUTS = ["total_shares", "book_value_per_share", "eps_ttm", "net_profit_yoy", "debt_to_equity"]

SETS = {"wq101": lambda: alpha101.FORMULAS, "alpha158": alpha158, "gtja191": gtja191, "quant33": quant33, "barra": barra}


def factor_set(name: str, factors: list[str] | None = None) -> dict[str, str]:
    """Formulas of a set, all or the named ones; unknown sets and factors raise."""
    if name not in SETS:
        raise ValueError(f"unknown factor set {name}; there are {', '.join(SETS)}")
    have = SETS[name]()
    if unknown := [f for f in factors or [] if f not in have]:
        raise ValueError(f"{name} has no {', '.join(unknown)}")
    return {f: have[f] for f in factors} if factors else dict(have)
