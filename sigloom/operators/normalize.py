"""Normalisation and reductions: aggregates of the other axes' groups, joined back where rows stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..frame import SignalFrame, Transform, align

_V = "value"


@dataclass
class ZScore(Transform):
    dim: str = "t"
    eps: float = 1e-8

    def apply(self, x: SignalFrame) -> SignalFrame:
        df = x.with_stats(x.keys(self.dim), m=F.avg(_V), s=F.stddev_samp(_V))
        return x.to(df.withColumn(_V, (F.col(_V) - F.col("m")) / (F.coalesce("s", F.lit(float("nan"))) + self.eps)))


@dataclass
class MinMax(Transform):
    dim: str = "t"
    eps: float = 1e-8
    range: tuple[float, float] = (0.0, 1.0)

    def apply(self, x: SignalFrame) -> SignalFrame:
        lo, hi = self.range
        df = x.with_stats(x.keys(self.dim), a=F.min(_V), b=F.max(_V))
        return x.to(df.withColumn(_V, (F.col(_V) - F.col("a")) / (F.col("b") - F.col("a") + self.eps) * (hi - lo) + lo))


@dataclass
class Normalize(Transform):
    """x / max(norm, eps), with the p-norm along the axis; p may be infinite."""

    p: float = 2.0
    dim: str = "channel"
    eps: float = 1e-8

    def apply(self, x: SignalFrame) -> SignalFrame:
        size = F.abs(_V)
        norm = F.max(size) if self.p == float("inf") else F.pow(F.sum(F.pow(size, F.lit(float(self.p)))), F.lit(1.0 / self.p))
        df = x.with_stats(x.keys(self.dim), norm=norm)
        return x.to(df.withColumn(_V, F.col(_V) / F.greatest("norm", F.lit(self.eps))))


def _biased(x: SignalFrame, by: list[str], eps: float) -> SignalFrame:
    df = x.with_stats(by, m=F.avg(_V), s=F.var_pop(_V))
    return x.to(df.withColumn(_V, (F.col(_V) - F.col("m")) / F.sqrt(F.col("s") + eps)))


@dataclass
class InstanceNorm(Transform):
    """Per first two axes (of two axes: per first) over the rest."""

    eps: float = 1e-5

    def apply(self, x: SignalFrame) -> SignalFrame:
        return _biased(x, list(x.axes[: min(2, len(x.axes) - 1)]), self.eps)


@dataclass
class LayerNorm(Transform):
    """Over the last ``n_axes`` axes."""

    n_axes: int = 1
    eps: float = 1e-5

    def apply(self, x: SignalFrame) -> SignalFrame:
        return _biased(x, list(x.axes[: len(x.axes) - self.n_axes]), self.eps)


@dataclass
class BatchNorm(Transform):
    """Over the first axis."""

    eps: float = 1e-5

    def apply(self, x: SignalFrame) -> SignalFrame:
        return _biased(x, list(x.axes[1:]), self.eps)


@dataclass
class GridNorm(Transform):
    """Channels in grids of equal size, each normalised over its electrodes and time."""

    electrodes: int
    eps: float = 1e-15

    def apply(self, x: SignalFrame) -> SignalFrame:
        y = SignalFrame(x.df.withColumn("grid", F.floor(F.col("channel") / self.electrodes)), (*x.axes, "grid"))
        df = y.with_stats([*x.keys("channel", "t"), "grid"], m=F.avg(_V), s=F.stddev_samp(_V))
        return x.to(df.withColumn(_V, (F.col(_V) - F.col("m")) / (F.col("s") + self.eps)))


@dataclass
class Mean(Transform):
    dim: str = "t"
    keepdim: bool = False

    def aggregate(self):
        return F.avg(_V)

    def apply(self, x: SignalFrame) -> SignalFrame:
        out = x.df.groupBy(*x.keys(self.dim)).agg(self.aggregate().alias(_V))
        return x.to(out.withColumn(self.dim, F.lit(0).cast("long"))) if self.keepdim else x.to(out, x.keys(self.dim))


class Sum(Mean):
    def aggregate(self):
        return F.sum(_V)


def euclidean_distance(pred: SignalFrame, truth: SignalFrame, dim: str = "xyz") -> DataFrame:
    """One row: the mean over all else of the distance along ``dim``."""
    off = F.col(_V) - F.col("other")
    both = align(pred, truth)
    each = both.df.groupBy(*both.keys(dim)).agg(F.sqrt(F.sum(off * off)).alias("d"))
    return each.agg(F.avg("d").alias(_V))


def mean_absolute_error(pred: SignalFrame, truth: SignalFrame) -> DataFrame:
    return align(pred, truth).df.agg(F.avg(F.abs(F.col(_V) - F.col("other"))).alias(_V))


def memory_usage(x: SignalFrame, by: str = "representation", item_bytes: int = 8) -> DataFrame:
    return x.df.groupBy(by).agg((F.count("*") * item_bytes).alias("n_bytes"))
