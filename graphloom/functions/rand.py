"""Reproducible randomness: values are hashes of a seed and of key columns, so that no partitioning changes them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A double in [0, 1), a function of seed and keys only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / float(1 << 53)


def uniform_int(low: int, high: int, seed: int, *keys: Column | str) -> Column:
    """An integer in [low, high]."""
    return (F.lit(low) + F.floor(uniform(seed, *keys) * (high - low + 1))).cast("long")


def normal(mean: Column | float, deviation: float, seed: int, *keys: Column | str) -> Column:
    """A normal value, by Box and Muller."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(seed, F.lit(1), *keys)))
    return F.lit(mean) + deviation * radius * F.cos(2 * math.pi * uniform(seed, F.lit(2), *keys))


def exponential(rate: Column, seed: int, *keys: Column | str) -> Column:
    """An exponential value of the given rate: in ascending order, a draw without replacement by weight."""
    return -F.log(1.0 - uniform(seed, *keys)) / rate


def survives(weight: Column, level: Column, seed: int, *keys: Column | str) -> Column:
    """Whether at least one of weight independent copies is kept at probability 2**-level each."""
    log_gone = weight * F.log1p(-F.pow(F.lit(2.0), -level))
    return F.when(level <= 0, weight > 0).otherwise(uniform(seed, *keys) < -F.expm1(log_gone))
