"""Statistics over IC series: resampling, multiple tests, and the normal and t distributions.

IC series have one row a day, so they fit a task; each factor's series is one group.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def two_sided_p(t: float) -> float:
    """The chance of a normal value at least as far from 0."""
    return math.erfc(abs(t) / math.sqrt(2))


def _seed(factor: str, seed: int) -> int:
    return (zlib.crc32(factor.encode()) + seed) % 2**32


def bootstrap_ic(ic: DataFrame, samples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(factor, ic_mean, low, high, p_value) by resampling days with replacement; the seed and the
    factor's name fix the draws. ``ic`` has (factor, ic); null values are left out, a factor without any has nulls."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, name = rows["ic"].dropna().to_numpy(), rows["factor"].iloc[0]
        if not len(x):
            return pd.DataFrame([(name, None, None, None, None)], columns=["factor", "ic_mean", "low", "high", "p_value"])
        x = np.sort(x)
        rng = np.random.default_rng(_seed(name, seed))
        means = np.concatenate([x[rng.integers(0, len(x), (min(500, samples - k), len(x)))].mean(1) for k in range(0, samples, 500)])
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        p = min(1.0, 2 * min((means <= 0).mean(), (means >= 0).mean()))
        return pd.DataFrame([(name, x.mean(), low, high, p)], columns=["factor", "ic_mean", "low", "high", "p_value"])

    return ic.groupBy("factor").applyInPandas(run, "factor string, ic_mean double, low double, high double, p_value double")


def shuffle_test(pairs: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(factor, corr, p_value): how often a random order of the returns correlates as much. ``pairs``
    has (factor, value, fwd) of one bounded section, such as daily means."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["factor"].iloc[0]
        rows = rows.dropna().sort_values(["value", "fwd"])
        x, y = rows["value"].to_numpy(), rows["fwd"].to_numpy()
        if len(x) < 3 or x.std() < 1e-12 or y.std() < 1e-12:
            return pd.DataFrame([(name, None, None)], columns=["factor", "corr", "p_value"])
        x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        own, rng = float((x * y).mean()), np.random.default_rng(_seed(name, seed))
        far = sum(abs(float((x * rng.permutation(y)).mean())) >= abs(own) for _ in range(rounds))
        return pd.DataFrame([(name, own, (far + 1) / (rounds + 1))], columns=["factor", "corr", "p_value"])

    return pairs.groupBy("factor").applyInPandas(run, "factor string, corr double, p_value double")


def confidence(ic_p: float, oos_kept: float, turnover: float, coverage: float, most_alike: float) -> tuple[float, str]:
    """A score from 0 to 100 of five parts (25, 25, 20, 15, 15) and its verdict."""
    score = 25 * (ic_p < 0.05) + 25 * min(1, max(0, oos_kept)) + 20 * max(0, 1 - turnover) + 15 * min(1, coverage) + 15 * max(0, 1 - most_alike)
    return score, "SAFE" if score >= 70 else "REVIEW" if score >= 40 else "REJECT"
