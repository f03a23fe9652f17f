"""Indexing, reshaping, padding and stacking: filters and index arithmetic, with row-major order throughout."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, functions as F

from . import blocks
from .windows import WindowFeature, features
from ..frame import Compose, Identity, SignalFrame, Transform


def _length(x: SignalFrame, dim: str) -> DataFrame:
    """One row with the axis's length ``n``."""
    return x.df.agg((F.max(dim) + 1).alias("n"))


@dataclass
class Index(Transform):
    """An int selects and drops the axis, a slice keeps and re-bases it, a list gathers in its order."""

    indices: int | slice | Sequence[int]
    dim: str = "channel"

    def apply(self, x: SignalFrame) -> SignalFrame:
        at, i = F.col(self.dim), self.indices
        if isinstance(i, int):
            df = x.df.where(at == i) if i >= 0 else x.df.join(F.broadcast(_length(x, self.dim))).where(at == F.col("n") + i)
            return x.to(df, x.keys(self.dim))
        df = x.df.join(F.broadcast(_length(x, self.dim)))
        if isinstance(i, slice):
            step = i.step or 1
            if step < 1:
                raise ValueError("the step must be positive")
            bound = lambda v: F.lit(v) if v >= 0 else F.greatest(F.lit(0), F.col("n") + v)
            lo, hi = bound(i.start or 0), F.col("n") if i.stop is None else bound(i.stop)
            df = df.where((at >= lo) & (at < hi) & ((at - lo) % step == 0))
            return x.to(df.withColumn(self.dim, F.floor((at - lo) / step)))
        # A list is a fixed number of places: each row is dealt to those that ask for it.
        asked = F.filter(F.array(*[F.struct(F.lit(k).cast("long").alias("pos"), (F.lit(v) if v >= 0 else F.col("n") + v).cast("long").alias("src")) for k, v in enumerate(i)]), lambda s: s["src"] == at)
        return x.to(df.withColumn("s", F.explode(asked)).withColumn(self.dim, F.col("s.pos")))


@dataclass
class Reshape(Transform):
    """To ``shape`` (one -1 allowed) with ``names``; ``sizes`` are the axes' lengths now. Where the first axis is the -1, its length now may be None."""

    shape: Sequence[int]
    names: Sequence[str]
    sizes: Sequence[int | None]

    def apply(self, x: SignalFrame) -> SignalFrame:
        shape = list(self.shape)
        if len(shape) != len(self.names) or len(self.sizes) != len(x.axes):
            raise ValueError(f"{self.sizes} can't be {self.shape}")
        if self.sizes[0] is None:
            if shape[0] >= 0:
                raise ValueError("a first axis of unknown length needs a -1 first")
        else:
            total, known = prod(self.sizes), prod(s for s in shape if s >= 0)
            shape = [total // known if s < 0 else s for s in shape]
            if prod(shape) != total:
                raise ValueError(f"{self.sizes} can't be {self.shape}")
        flat = reduce(lambda a, b: a + b, (F.col(a) * prod(self.sizes[k + 1 :]) for k, a in enumerate(x.axes)))
        df = x.df.select(flat.alias("__flat"), "value")
        places = [F.floor(F.col("__flat") / prod(shape[k + 1 :])) for k in range(len(shape))]
        return x.to(df.select(*[(p % shape[k] if k else p).alias(n) for k, (n, p) in enumerate(zip(self.names, places, strict=True))], "value"), self.names)


@dataclass
class Flatten(Transform):
    """Merge the axes from ``start`` to ``end`` (inclusive) into the first one's name; ``sizes`` of the later ones."""

    start: int
    end: int
    sizes: Sequence[int]
    name: str | None = None

    def apply(self, x: SignalFrame) -> SignalFrame:
        merged = x.axes[self.start : self.end % len(x.axes) + 1]
        name = self.name or merged[0]
        flat = F.col(merged[0])
        for a, n in zip(merged[1:], self.sizes, strict=True):
            flat = flat * n + F.col(a)
        axes = [*x.axes[: self.start], name, *x.axes[self.start + len(merged) :]]
        return x.to(x.df.withColumn("__flat", flat).drop(*merged).withColumnRenamed("__flat", name), axes)


@dataclass
class Squeeze(Transform):
    dim: str

    def apply(self, x: SignalFrame) -> SignalFrame:
        return x.to(x.df, x.keys(self.dim))


@dataclass
class Unsqueeze(Transform):
    """A new axis ``name`` of size 1 at place ``position``."""

    position: int
    name: str

    def apply(self, x: SignalFrame) -> SignalFrame:
        at = self.position if self.position >= 0 else len(x.axes) + 1 + self.position
        return x.to(x.df.withColumn(self.name, F.lit(0).cast("long")), [*x.axes[:at], self.name, *x.axes[at:]])


@dataclass
class Transpose(Transform):
    dims: Sequence[str | int]

    def apply(self, x: SignalFrame) -> SignalFrame:
        axes = [x.axes[d] if isinstance(d, int) else d for d in self.dims]
        if sorted(axes) != sorted(x.axes):
            raise ValueError(f"{axes} are not the axes {x.axes}")
        return x.to(x.df, axes)


@dataclass
class Repeat(Transform):
    """The whole axis again and again."""

    repeats: int
    dim: str = "channel"

    def apply(self, x: SignalFrame) -> SignalFrame:
        df = x.df.join(F.broadcast(_length(x, self.dim))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(self.repeats - 1))))
        return x.to(df.withColumn(self.dim, F.col(self.dim) + F.col("r") * F.col("n")))


@dataclass
class Pad(Transform):
    """Pad both ends. Each sample is dealt to the places that show it, so no join of samples is needed."""

    padding: tuple[int, int]
    dim: str = "t"
    mode: str = "constant"
    fill: float = 0.0

    def apply(self, x: SignalFrame) -> SignalFrame:
        before, after = self.padding
        t, n, by = F.col(self.dim), F.col("n"), x.keys(self.dim)
        df = x.with_stats(by, n=F.max(self.dim) + 1)
        first, last = F.lit(-before), n + (after - 1)

        def every(start: Column, period: Column) -> Column:
            """Places congruent to ``start`` by the period, from first to last."""
            lowest = start - period * F.floor((start - first) / period)
            return F.when(lowest <= last, F.sequence(lowest.cast("long"), last.cast("long"), period.cast("long"))).otherwise(F.array().cast("array<long>"))

        if self.mode == "circular":
            places = every(t, n)
        elif self.mode == "reflect":
            period = F.greatest(2 * (n - 1), F.lit(1))
            places = F.array_distinct(F.concat(every(t, period), every(-t, period)))
        elif self.mode in ("replicate", "constant"):
            ends = F.array(t)
            left = F.sequence(F.lit(-before).cast("long"), F.lit(-1).cast("long")) if before else F.array().cast("array<long>")
            right = F.sequence(n, n + after - 1) if after else F.array().cast("array<long>")
            places = F.concat(F.when(t == 0, left).otherwise(F.array().cast("array<long>")), ends, F.when(t == n - 1, right).otherwise(F.array().cast("array<long>")))
        else:
            raise ValueError(f"no padding mode {self.mode!r}")
        out = df.withColumn("place", F.explode(places))
        if self.mode == "constant":
            out = out.withColumn("value", F.when(F.col("place") == t, F.col("value")).otherwise(F.lit(float(self.fill))))
        return x.to(out.withColumn(self.dim, F.col("place") + before))


@dataclass
class Diff(Transform):
    """n-fold first differences; the axis gets shorter by n."""

    n: int = 1
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        df, along = blocks.with_halo(x.df, self.dim, self.n), blocks.along(x.keys(self.dim), self.dim)
        for _ in range(self.n):
            df = df.withColumn("value", F.col("value") - F.lag("value").over(along))
        return x.to(blocks.own(df, self.dim).where(F.col(self.dim) >= self.n).withColumn(self.dim, F.col(self.dim) - self.n))


def _steps(f: Callable[[SignalFrame], SignalFrame]) -> list[Callable[[SignalFrame], SignalFrame]]:
    """The operators that a branch runs in turn."""
    if isinstance(f, Compose):
        return [s for g in f.steps for s in _steps(g)]
    return [] if isinstance(f, Identity) else [f]


def _same(f: Callable, g: Callable) -> bool:
    """Whether two steps are the same operator with the same parameters."""
    return f is g or (isinstance(f, Transform) and type(f) is type(g) and all(type(v) is type(g.params[k]) and str(v) == str(g.params[k]) for k, v in f.params.items()) and all(isinstance(v, (int, float, str, bool, list, tuple, type(None))) for v in f.params.values()))


@dataclass
class Stack(Transform):
    """Branches of one input along a new first axis, numbered in their order.

    Steps that all branches begin with run once, and features of the same windows are one aggregate whose columns become rows.
    """

    branches: dict[str, Callable[[SignalFrame], SignalFrame]]
    dim: str = "representation"
    makes_dim = True

    def apply(self, x: SignalFrame) -> SignalFrame:
        rest = [_steps(f) for f in self.branches.values()]
        while len(rest) > 1 and all(rest) and all(_same(r[0], rest[0][0]) for r in rest[1:]):
            x, rest = rest[0][0](x), [r[1:] for r in rest]
        fused: dict[tuple, list[int]] = {}
        for k, r in enumerate(rest):
            if len(r) == 1 and isinstance(r[0], WindowFeature):
                key = (r[0].window_size, r[0].stride or r[0].window_size, x.axis(r[0].dim))
                fused.setdefault(key, []).append(k)
            else:
                fused[k,] = [k]
        parts, axes = [], set()
        for key, places in fused.items():
            if len(key) == 3:
                made, name = [replace(rest[k][0], dim=key[2]) for k in places], F.array(*[F.lit(k).cast("long") for k in places])
                df = features(x, made).select(*x.axes, F.posexplode(F.array(*[f"f{k}" for k in range(len(made))])).alias("__at", "value"))
                parts.append(df.withColumn(self.dim, name[F.col("__at")]))
                axes.add(x.axes)
            else:
                y = reduce(lambda z, f: f(z), rest[places[0]], x)
                parts.append(y.df.withColumn(self.dim, F.lit(places[0]).cast("long")))
                axes.add(y.axes)
        if len(axes) != 1:
            raise ValueError("the branches' axes differ")
        own = axes.pop()
        return x.to(reduce(DataFrame.unionByName, [p.select(self.dim, *own, "value") for p in parts]), (self.dim, *own))


@dataclass
class Concat(Transform):
    """Branches of one input one after another along an axis."""

    branches: dict[str, Callable[[SignalFrame], SignalFrame]]
    dim: str = "channel"

    def apply(self, x: SignalFrame) -> SignalFrame:
        parts, offset = [], F.lit(0)
        for k, f in enumerate(self.branches.values()):
            y = f(x)
            size = y.df.agg((F.max(self.dim) + 1).alias(f"n{k}"))
            parts.append((y, offset, [p[3] for p in parts], size))
            offset = offset + F.col(f"n{k}")
        out = []
        for y, start, before, _ in parts:
            df = reduce(lambda d, s: d.join(F.broadcast(s)), before, y.df)
            out.append(df.withColumn(self.dim, (F.col(self.dim) + start).cast("long")).select(*y.axes, "value"))
        return x.to(reduce(DataFrame.unionByName, out))


def circular_pad(x: SignalFrame, first: str, second: str, first_size: int = 2, second_size: int = 16) -> SignalFrame:
    """Both axes continued around their ends, as for a ring of grids."""
    return Pad((second_size, second_size), second, "circular")(Pad((first_size, first_size), first, "circular")(x))


def split_by_grid(x: SignalFrame, electrodes: int, dim: str = "channel") -> SignalFrame:
    """A channel axis of equal grids as (grid, channel in the grid)."""
    at = F.col(dim)
    axes = [c for a in x.axes for c in (("grid", dim) if a == dim else (a,))]
    return x.to(x.df.withColumn("grid", F.floor(at / electrodes)).withColumn(dim, at % electrodes), axes)
