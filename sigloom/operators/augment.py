"""Augmentation, in two halves: a seeded draw of a few numbers on the driver, and an exact application of them to all rows."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..frame import SignalFrame, Transform


def _n(x: SignalFrame, dim: str):
    return x.with_stats(x.keys(dim), n=(F.max(dim) + 1).cast("double"))


def _curve(knots: list[float], t: Column, n: Column) -> Column:
    """Linear interpolation of the knots over 0..n-1, ends aligned."""
    at = t * (len(knots) - 1) / F.greatest(n - 1, F.lit(1.0))
    k = F.least(F.floor(at), F.lit(max(0, len(knots) - 2))).cast("int")
    array = F.array(*[F.lit(float(v)) for v in knots])
    lo, hi = F.get(array, k), F.get(array, F.least(k + 1, F.lit(len(knots) - 1)))
    return lo + (hi - lo) * (at - k)


@dataclass
class MagnitudeWarp(Transform):
    """Times a curve through ``knots``, the same for every series."""

    knots: list[float]
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        return x.to(_n(x, self.dim).withColumn("value", F.col("value") * _curve(self.knots, F.col(self.dim), F.col("n"))))


@dataclass
class GridMagnitudeWarp(Transform):
    """Equal grids of channels, each times a curve through its own knots. The channels must divide by the grids."""

    knots: list[list[float]]
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        k = len(self.knots)
        sizes = x.df.agg((F.max("channel") + 1).alias("channels"))
        df = _n(x, self.dim).join(F.broadcast(sizes))  # one row
        grid = F.when(F.col("channels") % k == 0, F.floor(F.col("channel") * k / F.col("channels"))).otherwise(F.raise_error(F.lit(f"the channels don't divide by {k} grids")).cast("long"))
        curve = F.lit(None).cast("double")
        for g, knots in enumerate(self.knots):
            curve = F.when(grid == g, _curve(knots, F.col(self.dim), F.col("n"))).otherwise(curve)
        return x.to(df.withColumn("value", F.col("value") * curve))


@dataclass
class TimeWarp(Transform):
    """Samples taken, with linear interpolation, at warped places: even knots plus ``shifts`` (in units of n / inner knots)."""

    shifts: list[float]
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        keys, inner = x.keys(self.dim), len(self.shifts) - 2
        t, n = F.col(self.dim), F.col("n")
        df = _n(x, self.dim)
        at = t * (inner + 1) / F.greatest(n - 1, F.lit(1.0))
        k = F.least(F.floor(at), F.lit(inner)).cast("int")
        array = F.array(*[F.lit(float(v)) for v in self.shifts])

        def knot(i: Column) -> Column:
            return F.least(F.greatest(i * (n - 1) / (inner + 1) + F.get(array, i) * (n / inner), F.lit(0.0)), n - 1)

        source = knot(k) + (knot(k + 1) - knot(k)) * (at - k)
        df = df.withColumn("src", source).withColumn("a", F.floor("src")).withColumn("b", F.least(F.col("a") + 1, (n - 1).cast("long")))
        place = x.df.select(*keys, F.col(self.dim).alias("__p"), F.col("value").alias("v"))
        # Each target asks for two places, so one join brings both.
        ask = df.select(*x.axes, "src", "a", F.explode(F.array_distinct(F.array("a", "b"))).alias("__p"), "b")
        got = ask.join(place, [*keys, "__p"]).withColumn("f", F.col("src") - F.col("a"))
        weight = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("__p") == F.col("a"), 1 - F.col("f")).otherwise(F.col("f"))
        return x.to(got.groupBy(*x.axes).agg(F.sum(weight * F.col("v")).alias("value")))


@dataclass
class TimeShift(Transform):
    """Shift by a number of samples, or by a fraction of the series' length, rounded towards zero.

    The freed end is ``zero``, ``wrap``, ``edge`` (the sample at the shift) or ``edge_true`` (the end's). A shift of the whole length or more
    frees every place; the sample at the shift is then the last one on that side.
    """

    shift: float
    fill: str = "zero"
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        if self.fill not in ("zero", "wrap", "edge", "edge_true"):
            raise ValueError(f"no fill {self.fill!r}")
        t, n = F.col(self.dim), F.col("n")
        df = _n(x, self.dim).withColumn("n", F.col("n").cast("long"))
        s = (n * F.lit(self.shift)).cast("long") if isinstance(self.shift, float) else F.lit(self.shift).cast("long")
        df = df.withColumn("s", s)
        s, none = F.col("s"), F.array().cast("array<bigint>")
        if self.fill in ("zero", "wrap"):
            out = df.withColumn(self.dim, F.pmod(t + s, n))
            freed = F.when(s > 0, F.col(self.dim) < s).otherwise(F.col(self.dim) >= n + s)
            return x.to(out.withColumn("value", F.when(freed, 0.0).otherwise(F.col("value"))) if self.fill == "zero" else out)
        source = F.when(s > 0, F.least(s, n - 1)).otherwise(F.greatest(n + s - 1, F.lit(0))) if self.fill == "edge" else F.when(s > 0, F.lit(0)).otherwise(n - 1)
        own = F.when((t + s >= 0) & (t + s < n), F.array(t + s)).otherwise(none)
        freed = F.when(s > 0, F.sequence(F.lit(0).cast("long"), F.least(s, n) - 1)).when(s < 0, F.sequence(F.greatest(n + s, F.lit(0)), n - 1)).otherwise(none)
        # The sample that fills the freed end is dealt to all of it.
        places = F.concat(own, F.when(t == source, freed).otherwise(none))
        return x.to(df.withColumn("__to", F.explode(places)).withColumn(self.dim, F.col("__to")))


@dataclass
class Scale(Transform):
    factor: float

    def apply(self, x: SignalFrame) -> SignalFrame:
        return x.with_value(F.col("value") * self.factor)


@dataclass
class Cutout(Transform):
    """Zero in [start, start + length) for each start. A length below 1 is a fraction of the series'; a start given as a fraction is one of the places that leave room for the length."""

    starts: list[float]
    length: float
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        v, t = F.col("value"), F.col(self.dim)
        by_length = any(isinstance(k, float) for k in (*self.starts, self.length))
        df, n = (_n(x, self.dim), F.col("n")) if by_length else (x.df, None)
        length = F.floor(n * self.length) if isinstance(self.length, float) else F.lit(self.length)
        for s in self.starts:
            start = F.floor((n - length + 1) * s) if isinstance(s, float) else F.lit(s)
            v = F.when((t >= start) & (t < start + length), 0.0).otherwise(v)
        return x.to(df.withColumn("value", v))


@dataclass
class ChannelPermute(Transform):
    """New channel i is old channel ``order[i]``."""

    order: list[int]
    dim: str = "channel"

    def apply(self, x: SignalFrame) -> SignalFrame:
        to = F.array(*[F.lit(self.order.index(c)) for c in range(len(self.order))])
        return x.to(x.df.withColumn(self.dim, F.get(to, F.col(self.dim).cast("int")).cast("long")))


@dataclass
class DropSlices(Transform):
    """Zero whole slices of an axis, without rescaling."""

    dropped: list[int]
    dim: str = "channel"

    def apply(self, x: SignalFrame) -> SignalFrame:
        return x.with_value(F.when(F.col(self.dim).isin(self.dropped), 0.0).otherwise(F.col("value")))


#: Fixed values of the mixing of places: odd multipliers, as in Knuth's multiplicative hashing.
_MIX = (2_654_435_761, 1_597_334_677)


def uniform(axes: tuple[str, ...], seed: int, turn: int = 0) -> Column:
    """A number in [0, 1) that depends on the place and the seed alone, so a recomputed partition draws the same. Integer arithmetic, so any engine can draw it."""
    h = F.lit((seed * 7_919 + turn * 104_729 + 1) % (1 << 32)).cast("long")
    for a in axes:
        for m in _MIX:
            h = F.pmod((h.bitwiseXOR(F.pmod(F.col(a), F.lit(1 << 32)))) % F.lit(1 << 31) * F.lit(m), F.lit(1 << 32))
            h = h.bitwiseXOR(F.shiftright(h, 15))
    return h / float(1 << 32)


@dataclass
class Dropout(Transform):
    """Each sample is zeroed with probability p and the others scaled by 1 / (1 - p)."""

    p: float = 0.1
    seed: int = 0

    def apply(self, x: SignalFrame) -> SignalFrame:
        u = uniform(x.axes, self.seed)
        return x.with_value(F.when(u < self.p, 0.0).otherwise(F.col("value") / (1 - self.p)))


def _normal(axes: tuple[str, ...], seed: int) -> Column:
    """A standard normal that depends on the place and the seed alone (Box-Muller on two draws)."""
    return F.sqrt(-2 * F.log(1 - uniform(axes, seed, 1))) * F.cos(6.283185307179586 * uniform(axes, seed, 2))


@dataclass
class GaussianNoise(Transform):
    std: float = 0.1
    seed: int = 0

    def apply(self, x: SignalFrame) -> SignalFrame:
        return x.with_value(F.col("value") + self.std * _normal(x.axes, self.seed))


@dataclass
class NoiseAtSNR(Transform):
    """Noise of the power that gives each series the signal-to-noise ratio, in decibels."""

    snr_db: float
    seed: int = 0
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        df = x.with_stats(x.keys(self.dim), p=F.avg(F.col("value") * F.col("value")))
        return x.to(df.withColumn("value", F.col("value") + F.sqrt(F.col("p") / 10 ** (self.snr_db / 10)) * _normal(x.axes, self.seed)))


@dataclass
class Randomly(Transform):
    """With probability p the operator that ``draw`` makes from a seeded generator, else the input; one decision per call."""

    draw: Callable[[random.Random], Transform]
    p: float = 1.0
    seed: int = 0

    def apply(self, x: SignalFrame) -> SignalFrame:
        rng = random.Random(self.seed)
        return x if rng.random() > self.p else self.draw(rng)(x)


def draw_magnitude_warp(sigma: float = 0.2, n_knots: int = 4) -> Callable[[random.Random], Transform]:
    return lambda r: MagnitudeWarp([r.gauss(1, sigma) for _ in range(n_knots)])


def draw_time_warp(sigma: float = 0.2, n_knots: int = 4) -> Callable[[random.Random], Transform]:
    def draw(r: random.Random) -> Transform:
        total, shifts = 0.0, [0.0]
        for _ in range(n_knots):
            total += r.gauss(0, 1)
            shifts.append(total * sigma)
        return TimeWarp([*shifts, shifts[-1]])

    return draw


def draw_time_shift(max_shift: float = 100, fill: str = "zero") -> Callable[[random.Random], Transform]:
    """A shift of up to ``max_shift`` samples either way; below 1, of up to that fraction of the length."""
    return lambda r: TimeShift(r.uniform(-max_shift, max_shift) if isinstance(max_shift, float) and max_shift < 1 else r.randint(-int(max_shift), int(max_shift)), fill)


def draw_scale(lo: float = 0.8, hi: float = 1.2) -> Callable[[random.Random], Transform]:
    return lambda r: Scale(r.uniform(lo, hi))


def draw_cutout(n_samples: int | None = None, n_holes: int = 1, length: float = 50) -> Callable[[random.Random], Transform]:
    """Holes anywhere; without ``n_samples`` their places are fractions of each series' length."""
    return lambda r: Cutout([r.random() if n_samples is None else r.randint(0, n_samples - int(length)) for _ in range(n_holes)], length)


def draw_channel_shuffle(n_channels: int) -> Callable[[random.Random], Transform]:
    return lambda r: ChannelPermute(r.sample(range(n_channels), n_channels))
