"""Sliding-window features.

A sample is dealt to the windows that hold it (a projection where windows don't overlap, else an explode
of at most ceil(size / stride) ids) and windows are one partial and one final aggregate. Only full windows
count, so trailing samples drop out. Features of differences and functions of whole windows work on blocks of windows that hold all samples
of theirs, so a long series is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks
from ..frame import SignalFrame, Transform


def deal(df: DataFrame, size: int, stride: int, dim: str) -> DataFrame:
    """Add ``win`` and ``pos``, the sample's place in the window; one row per sample and window."""
    at = F.col(dim)
    first, last = blocks.window_span(dim, size, stride)
    if "__block" in df.columns:  # only the block's own windows
        n = blocks.windows_of_block(stride)
        first, last = F.greatest(first, F.col("__block") * n), F.least(last, F.col("__block") * n + (n - 1))
    if stride >= size:
        out = df.withColumn("win", F.floor(at / stride))
    else:
        out = df.withColumn("win", F.explode(F.sequence(first, last)))
    return out.withColumn("pos", F.col(dim) - F.col("win") * stride).where(F.col("pos") < size)


def features(x: SignalFrame, made: Sequence[WindowFeature]) -> DataFrame:
    """(keys, axis, f0, f1, ...): several features of the same windows, from one pass over the samples and one aggregate."""
    of = made[0]
    size, stride, dim = of.window_size, of.stride or of.window_size, of.dim
    if size < 1:
        raise ValueError("the window must hold a sample")
    df, keys, lags = x.df, x.keys(dim), max(f.lags for f in made)
    if lags:
        # Differences count within a window only, so the samples of a block's windows are all that it needs.
        df, along = blocks.with_window_blocks(df, dim, size, stride), blocks.along(keys, dim)
        df = df.withColumns({n: F.lag("value", k).over(along) for k, n in ((1, "prev"), (2, "prev2")) if k <= lags})
        keys = [*keys, "__block"]
    done = deal(df, size, stride, dim).groupBy(*keys, "win").agg(*[f.feature().alias(f"f{k}") for k, f in enumerate(made)], F.count("*").alias("n")).where(F.col("n") == size)
    return done.select(*x.keys(dim), F.col("win").alias(dim), *[f"f{k}" for k in range(len(made))])


@dataclass
class WindowFeature(Transform):
    """``feature`` of each full window; the axis then counts windows. Subclass and give ``feature``, an aggregate of value, prev and prev2."""

    window_size: int
    stride: int | None = None
    dim: str = "t"
    lags = 0

    def feature(self) -> Column:
        raise NotImplementedError

    def apply(self, x: SignalFrame) -> SignalFrame:
        return x.to(features(x, [self]).withColumnRenamed("f0", "value"))


@dataclass
class WindowFunction(Transform):
    """Any vectorised function of whole windows: ``func`` gets an array (windows, samples) and returns a number per window.

    Blocks of windows are spread over tasks and reach ``func`` one at a time, as a view on the block's samples. Only full windows count.
    Instead of giving ``func``, a subclass may define ``compute``.
    """

    window_size: int
    stride: int | None = None
    func: Callable[[np.ndarray], np.ndarray] | None = None
    dim: str = "t"

    def compute(self, windows: np.ndarray) -> np.ndarray:
        if self.func is None:
            raise NotImplementedError("give func, or define compute")
        return self.func(windows)

    def apply(self, x: SignalFrame) -> SignalFrame:
        size, stride, dim, keys, compute = self.window_size, self.stride or self.window_size, self.dim, x.keys(self.dim), self.compute
        if size < 1:
            raise ValueError("the window must hold a sample")
        n = blocks.windows_of_block(stride)
        rows = blocks.with_window_blocks(x.df.select(*keys, dim, "value"), dim, size, stride).select(*keys, "__block", dim, "value")
        rows = rows.repartition(*keys, "__block").sortWithinPartitions(*keys, "__block", dim)
        schema = to_arrow_schema(rows.select(*keys, dim, "value").schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in blocks.groups_of(batches, [*keys, "__block"]):
                first = t["__block"][0].as_py() * n
                place = t[dim].to_numpy() - first * stride
                if place[-1] + 1 < size:
                    continue
                held, there = np.zeros(int(place[-1]) + 1), np.zeros(int(place[-1]) + 1, bool)
                held[place], there[place] = t["value"].to_numpy(zero_copy_only=False), True
                whole = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(there, size)[::stride].all(axis=1))
                windows = np.lib.stride_tricks.sliding_window_view(held, size)[::stride]
                got = np.asarray(compute(windows if len(whole) == len(windows) else windows[whole]), float)
                if got.shape != whole.shape:
                    raise ValueError(f"one number per window is needed; {len(whole)} windows gave {got.shape}")
                columns = [pa.array(np.full(len(got), t[k][0].as_py())) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(whole + first), pa.array(got)], schema=schema)

        return x.to(rows.mapInArrow(run, x.df.select(*keys, dim, "value").schema))


class RMS(WindowFeature):
    def feature(self) -> Column:
        return F.sqrt(F.avg(F.col("value") * F.col("value")))


class MAV(WindowFeature):
    def feature(self) -> Column:
        return F.avg(F.abs("value"))


@dataclass
class VAR(WindowFeature):
    """Unbiased by default; ``ddof=0`` divides by the number of samples."""

    ddof: int = 1

    def feature(self) -> Column:
        return F.var_samp("value") if self.ddof else F.var_pop("value")


class IAV(WindowFeature):
    def feature(self) -> Column:
        return F.sum(F.abs("value"))


class WaveformLength(WindowFeature):
    lags = 1

    def feature(self) -> Column:
        return F.coalesce(F.sum(F.when(F.col("pos") >= 1, F.abs(F.col("value") - F.col("prev")))), F.lit(0.0))


@dataclass
class ZeroCrossings(WindowFeature):
    """Neighbours of different sign; ``halved`` counts half the sign's step, rounded down, so a zero between doesn't count."""

    halved: bool = False
    lags = 1

    def step(self, now: Column, before: Column) -> Column:
        apart = F.abs(F.signum(now) - F.signum(before))
        return F.floor(apart / 2).cast("double") if self.halved else (apart > 0).cast("double")

    def feature(self) -> Column:
        return F.coalesce(F.sum(F.when(F.col("pos") >= 1, self.step(F.col("value"), F.col("prev")))), F.lit(0.0))


class SlopeSignChanges(ZeroCrossings):
    lags = 2

    def feature(self) -> Column:
        return F.coalesce(F.sum(F.when(F.col("pos") >= 2, self.step(F.col("value") - F.col("prev"), F.col("prev") - F.col("prev2")))), F.lit(0.0))


@dataclass
class Chunk(Transform):
    """Windows kept whole: a new first axis ``chunk``, and the place in it along ``dim``."""

    window_size: int
    stride: int | None = None
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        stride, keys = self.stride or self.window_size, x.keys(self.dim)
        sizes = x.df.groupBy(*keys).agg((F.max(self.dim) + 1).alias("n"))
        dealt = deal(x.df, self.window_size, stride, self.dim).join(sizes, keys) if keys else deal(x.df, self.window_size, stride, self.dim).join(F.broadcast(sizes))
        full = dealt.where(F.col("win") * stride + self.window_size <= F.col("n"))
        return x.to(full.drop(self.dim).withColumnsRenamed({"win": "chunk", "pos": self.dim}), ("chunk", *x.axes))


@dataclass
class Median(Transform):
    """Median of an odd window around each sample; places near an end take the nearest full window's."""

    kernel_size: int
    dim: str = "t"

    def __post_init__(self):
        if self.kernel_size % 2 == 0:
            raise ValueError("the window's size must be odd")

    def apply(self, x: SignalFrame) -> SignalFrame:
        h, keys = self.kernel_size // 2, x.keys(self.dim)
        mid = blocks.with_halo(x.df, self.dim, h, h).withColumn("m", F.expr("percentile(value, 0.5)").over(blocks.along(keys, self.dim).rowsBetween(-h, h)))
        full = blocks.own(mid, self.dim).select(*keys, F.col(self.dim).alias("__at"), "m")
        n = x.with_stats(keys, n=F.max(self.dim) + 1).select(*x.axes, "n")
        near = n.withColumn("__at", F.least(F.greatest(F.col(self.dim), F.lit(h)), F.col("n") - 1 - h))
        return x.to(near.join(full, [*keys, "__at"]).withColumnRenamed("m", "value"))
