"""Reproducible randomness from hashes: the same on any partitioning and after any retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) from the keys and the seed."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**52)) + 0.5) / float(2**52)


def hash_normal(seed: int, *keys: Column | str) -> Column:
    """Standard normal from two hash uniforms (Box-Muller)."""
    u, v = hash_uniform(seed, *keys), hash_uniform(seed + 1_000_003, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def jitter(x: Column, sigma: float, seed: int, *keys: Column | str) -> Column:
    """Multiplicative noise x · (1 + σ z)."""
    return x * (1 + F.lit(sigma) * hash_normal(seed, *keys))
