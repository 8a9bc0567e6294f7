"""Random numbers as columns: a hash of a seed and of keys, so a value depends on neither
partitioning nor retries, and SQL engines agree on it."""

from __future__ import annotations

import math
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 32)


def resolve(seed: int | None) -> int:
    """None asks for a seed drawn now; every number is an ordinary seed."""
    return secrets.randbits(31) if seed is None else seed


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """In [0, 1)."""
    parts = [F.lit(seed)] + [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / SCALE


def normal(seed: int, *keys: Column | str | int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """Box-Muller on two uniform values."""
    u, v = uniform(seed, *keys, F.lit("u")), uniform(seed, *keys, F.lit("v"))
    return mean + deviation * F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def log_normal(seed: int, *keys: Column | str | int, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return F.exp(normal(seed, *keys, mean=mu, deviation=sigma))


def exponential(seed: int, *keys: Column | str | int, rate: float = 1.0) -> Column:
    return -F.ln(1 - uniform(seed, *keys)) / rate


def pareto(seed: int, *keys: Column | str | int, least: float = 1.0, alpha: float = 1.0) -> Column:
    return least / F.pow(1 - uniform(seed, *keys), F.lit(1 / alpha))


def between(seed: int, *keys: Column | str | int, low: float = 0.0, high: float = 1.0) -> Column:
    return low + (high - low) * uniform(seed, *keys)


def binomial(seed: int, *keys: Column | str | int, n: int, p: float) -> Column:
    """Of n trials, those that succeed."""
    trials = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
    return F.size(F.filter(trials, lambda i: uniform(seed, *keys, i) < p))


def poisson(seed: int, *keys: Column | str | int, mean: float) -> Column:
    """Smallest k whose cumulative probability passes a uniform value. Terms are summed
    as far as doubles tell them from 1."""
    most = int(mean + 12 * math.sqrt(mean) + 40)
    u = uniform(seed, *keys)
    start = F.struct(F.lit(math.exp(-mean)).alias("p"), F.lit(0.0).alias("below"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        below = acc["below"] + acc["p"]
        return F.struct((acc["p"] * mean / i).alias("p"), below.alias("below"), F.when(below <= u, i).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["k"]
