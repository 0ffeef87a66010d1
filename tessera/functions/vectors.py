"""Dense vectors as arrays, and learning-rate schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column, eps: float = 1e-12) -> Column:
    """Divided by the norm, or by ``eps`` where that is smaller (a zero vector stays zero)."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(as_doubles(v), lambda x: x / n)


def cosine_warmup(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear to 1 over ``warmup`` steps, then half a cosine down to 0 at ``total``."""
    rest = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * rest)))


def clamped_scale(log_scale: Column, top: float = 100.0) -> Column:
    """exp of the stored log temperature, at most ``top``."""
    return F.exp(F.least(log_scale, F.lit(math.log(top))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus_neg(x: Column) -> Column:
    """-log(sigmoid(x)), stable for both signs."""
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
