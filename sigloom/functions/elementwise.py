"""Elementwise operators: projections inside generated code."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..frame import SignalFrame, Transform, align


#: Terms of the series below 2 and levels of the continued fraction above; both leave less than 1e-13.
_TERMS, _LEVELS = 36, 36


def erf(x: Column) -> Column:
    """The error function, which Spark lacks: a series with positive terms for small arguments, else a continued fraction of its complement."""
    z, size = x * x, F.abs(x)
    series = F.lit(1.0)
    for n in range(_TERMS, 0, -1):
        series = F.lit(1.0) + F.lit(2.0 / (2 * n + 1)) * z * series
    fraction = size
    for n in range(_LEVELS, 0, -1):
        fraction = size + F.lit(n / 2.0) / fraction
    bell = F.exp(-z)
    return F.when(size < 2, F.lit(2 / math.sqrt(math.pi)) * x * bell * series).otherwise(F.signum(x) * (F.lit(1.0) - bell / (F.lit(math.sqrt(math.pi)) * fraction)))


class Rectify(Transform):
    def apply(self, x: SignalFrame) -> SignalFrame:
        return x.with_value(F.abs("value"))


@dataclass
class ClampRange(Transform):
    min: float | None = None
    max: float | None = None

    def __post_init__(self):
        if self.min is None and self.max is None:
            raise ValueError("give min, max or both")

    def apply(self, x: SignalFrame) -> SignalFrame:
        v = F.col("value")
        v = v if self.min is None else F.greatest(v, F.lit(float(self.min)))
        return x.with_value(v if self.max is None else F.least(v, F.lit(float(self.max))))


@dataclass
class Standardize(Transform):
    """(x - mean) / (std + eps) by numbers, or by signals over some of the axes."""

    mean: float | SignalFrame
    std: float | SignalFrame
    eps: float = 1e-8

    def apply(self, x: SignalFrame) -> SignalFrame:
        df, of = x.df, {}
        for name in ("mean", "std"):
            given = getattr(self, name)
            if isinstance(given, SignalFrame):
                df = df.join(given.df.withColumnRenamed("value", f"__{name}"), list(given.axes))
                of[name] = F.col(f"__{name}")
            else:
                of[name] = F.lit(float(given))
        return x.to(df.withColumn("value", (F.col("value") - of["mean"]) / (of["std"] + self.eps)))


# The activations' usual constants.
def pserf(v: Column, gamma: float = 1.0, sigma: float = 1.25, stabilisation: float = 1e-12) -> Column:
    return v * erf(gamma * F.log1p(F.exp(sigma * v))) + stabilisation


def sau(v: Column, alpha: float = 0.15, n: float = 20_000.0) -> Column:
    bell = math.sqrt(2 / math.pi) * F.exp(-(n**2) * v * v / 2) / (2 * n)
    return bell + (1 + alpha) / 2 * v + (1 - alpha) / 2 * v * erf(n * v / math.sqrt(2))


def smu(v: Column, alpha: float = 0.01, mu: float = 2.5) -> Column:
    return ((1 + alpha) * v + (1 - alpha) * v * erf(mu * (1 - alpha) * v)) / 2


def weighted_sum(a: SignalFrame, b: SignalFrame, alpha: float = 0.5) -> SignalFrame:
    return align(a, b).with_value(alpha * F.col("value") + (1 - alpha) * F.col("other"))
