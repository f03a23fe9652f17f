"""Signals as long DataFrames: one BIGINT column per named axis and a DOUBLE ``value``.

An operator is a callable from ``SignalFrame`` to ``SignalFrame`` that only adds to the logical plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, is_dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Axes by number of dimensions, where none are named.
DEFAULT_AXES = {1: ("t",), 2: ("channel", "t"), 3: ("batch", "channel", "t"), 4: ("batch", "representation", "channel", "t")}


#: Places of the usual axes in a signal whose axes have no names of their own; any other name is the last axis.
_PLACES = {"batch": 0, "representation": 1, "channel": -2}
#: Rows of a signal that is paired with every value of another; beyond, share an axis instead.
BROADCAST_ROWS = 1_000_000


class TransformError(Exception):
    """An operator failed; the message has its parameters and the signal's axes."""


@dataclass(frozen=True)
class SignalFrame:
    """``df`` holds the axis columns in ``axes`` and ``value``; ``fs`` is the sampling rate, ``grids`` the electrode table."""

    df: DataFrame
    axes: tuple[str, ...]
    fs: float | None = None
    grids: DataFrame | None = None

    def __post_init__(self):
        if lacking := [c for c in (*self.axes, "value") if c not in self.df.columns]:
            raise ValueError(f"no column {lacking}; the table has {self.df.columns}")
        if self.fs is not None and self.fs <= 0:
            raise ValueError("the sampling rate must be positive")

    @property
    def unnamed(self) -> bool:
        return all(re.fullmatch(r"dim_\d+", a) for a in self.axes)

    def axis(self, dim: str) -> str:
        """The axis called ``dim``; by its usual place where axes have no names of their own."""
        if dim in self.axes:
            return dim
        if not self.unnamed:
            raise ValueError(f"no axis {dim!r} among {self.axes}")
        place = _PLACES.get(dim, -1)
        if not -len(self.axes) <= place < len(self.axes):
            raise ValueError(f"no axis {dim!r} among {self.axes}")
        return self.axes[place]

    def keys(self, *dims: str) -> list[str]:
        """All axes but ``dims``."""
        return [a for a in self.axes if a not in dims]

    def to(self, df: DataFrame, axes: Sequence[str] | None = None) -> SignalFrame:
        axes = tuple(self.axes if axes is None else axes)
        return replace(self, df=df.select(*axes, "value"), axes=axes)

    def with_value(self, value: Column) -> SignalFrame:
        return self.to(self.df.withColumn("value", value))

    def with_stats(self, by: list[str], **aggregates: Column) -> DataFrame:
        """The rows with aggregates of their group. Aggregated before the shuffle and joined back, so a hot group is never in one task."""
        stats = self.df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])
        return self.df.join(stats, by) if by else self.df.join(F.broadcast(stats))  # without keys: one row


def signal(df: DataFrame, axes: Sequence[str] | None = None, fs: float | None = None, grids: DataFrame | None = None) -> SignalFrame:
    """A table as a signal; the axes default by their number. Electrode grids are checked: each has an electrode and none twice."""
    n = len(df.columns) - 1
    names = tuple(axes or DEFAULT_AXES.get(n, tuple(f"dim_{i}" for i in range(n))))
    if axes is None and set(names) != set(df.columns) - {"value"}:
        names = tuple(c for c in df.columns if c != "value")
    if grids is not None:
        from .operators.spatial import check_grids

        check_grids(grids)
    return SignalFrame(df.select(*[F.col(a).cast("long").alias(a) for a in names], F.col("value").cast("double").alias("value")), names, fs, grids)


def emg_signal(df: DataFrame, fs: float = 2048.0, grids: DataFrame | None = None) -> SignalFrame:
    return signal(df, fs=fs, grids=grids)


def from_array(spark: SparkSession, array, axes: Sequence[str] | None = None, fs: float | None = None) -> SignalFrame:
    """A driver-side array as a signal: small inputs and tests; larger data comes from files."""
    import numpy as np

    a = np.asarray(array, dtype=float)
    names = tuple(axes or DEFAULT_AXES.get(a.ndim, tuple(f"dim_{i}" for i in range(a.ndim))))
    at = np.indices(a.shape).reshape(a.ndim, -1)
    rows = [(*map(int, k), float(v)) for k, v in zip(at.T, a.ravel(), strict=True)]
    return SignalFrame(spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", value double"), names, fs)


class Transform:
    """An operator. Subclasses are dataclasses with ``apply``; ``dim``, where they have one, must be an axis."""

    def apply(self, x: SignalFrame) -> SignalFrame:
        raise NotImplementedError

    @property
    def params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)} if is_dataclass(self) else {}

    def __call__(self, x: SignalFrame) -> SignalFrame:
        if not isinstance(x, SignalFrame):
            raise TypeError(f"expected a SignalFrame, got {type(x).__name__}")
        dim, own = getattr(self, "dim", None), self
        if isinstance(dim, str) and dim not in x.axes and not getattr(self, "makes_dim", False):
            own = replace(self, dim=x.axis(dim))
        try:
            return own.apply(x)
        except (TypeError, KeyError, ArithmeticError) as e:
            raise TransformError(f"{type(self).__name__}({self.params}) on axes {x.axes}: {e}") from e


@dataclass
class Compose(Transform):
    """Operators in turn."""

    steps: Sequence[Callable[[SignalFrame], SignalFrame]]

    def apply(self, x: SignalFrame) -> SignalFrame:
        return reduce(lambda y, f: f(y), self.steps, x)


Pipeline = Compose


@dataclass
class Lambda(Transform):
    """A function of the value column, a SQL expression, or a function of the whole signal (``whole``)."""

    func: Callable | str
    whole: bool = False

    def apply(self, x: SignalFrame) -> SignalFrame:
        if self.whole:
            return self.func(x)
        return x.with_value(F.expr(self.func) if isinstance(self.func, str) else self.func(F.col("value")))


class Identity(Transform):
    def apply(self, x: SignalFrame) -> SignalFrame:
        return x


def align(a: SignalFrame, b: SignalFrame) -> SignalFrame:
    """Values of both (``value``, and ``other`` for b's) on the axes of a and then those that only b has, matched on the axes they share.

    Without a shared axis every value of a meets every one of b, which must have BROADCAST_ROWS values at most.
    """
    shared = [c for c in a.axes if c in b.axes]
    right = b.df.withColumnRenamed("value", "other")
    if shared:
        df = a.df.join(right, shared)
    elif b.df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        df = a.df.crossJoin(F.broadcast(right))
    else:
        raise ValueError(f"{a.axes} and {b.axes} share no axis, and the second signal has more than {BROADCAST_ROWS} values")
    return replace(a, df=df, axes=(*a.axes, *[c for c in b.axes if c not in shared]))
