"""Orthogonal wavelets: a level is a stencil of a few taps and every second place kept.

All levels of a block of samples are worked out at once in Arrow batches, forwards and back: a block gets copies of the few values that its
taps reach in its neighbour and, as series go on around their ends, at the series' other end. No task holds a series, and samples are shuffled
once each way. A series of odd length repeats its last sample first. A level of n samples has ceil(n / 2) coefficients of each kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks
from ..frame import SignalFrame, Transform

_R2, _R3 = math.sqrt(2), math.sqrt(3)
#: The low-pass taps by name.
TAPS = {
    "haar": (1 / _R2, 1 / _R2),
    "db2": ((1 + _R3) / (4 * _R2), (3 + _R3) / (4 * _R2), (3 - _R3) / (4 * _R2), (1 - _R3) / (4 * _R2)),
}


def taps(wavelet: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The low-pass and the high-pass taps."""
    if wavelet not in TAPS:
        raise ValueError(f"no wavelet {wavelet!r} among {sorted(TAPS)}")
    low = TAPS[wavelet]
    return low, tuple((-1) ** j * v for j, v in enumerate(reversed(low)))


Taps = Sequence[float]


def lengths(n: int, level: int) -> list[int]:
    """A series' length and those of its coefficients by level."""
    made = [n]
    for _ in range(level):
        made.append(-(-made[-1] // 2))
    return made


def block_size(level: int, reach: int) -> int:
    """About BLOCK samples, a whole number of the last level's coefficients; beyond a block's end its taps reach less than a block."""
    step = 1 << level
    return -(-max(blocks.BLOCK, step * reach) // step) * step


def analyse(body: np.ndarray, head: np.ndarray, first: int, n: int, level: int, low: Taps, high: Taps) -> list[np.ndarray]:
    """The smoothed part and the details by level of a block: ``body`` has the series' samples from ``first`` on, ``head`` the series' first ones, if the block sees the end."""
    made, taps_ = [], len(low)

    def both(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = max(0, (len(v) - taps_) // 2 + 1)
        parts = [v[j : j + 2 * m : 2][:m] for j in range(taps_)]
        return sum(h * p for h, p in zip(low, parts, strict=True)), sum(g * p for g, p in zip(high, parts, strict=True))

    for _ in range(level):
        around = head if first else body
        if first + len(body) == n:
            if n % 2:
                body = np.r_[body, body[-1:]]
                around = around if first else body
            body = np.r_[body, np.resize(around, taps_ - 2)]
        body, detail = both(body)
        head = both(head)[0]
        made.append(detail)
        first, n = first // 2, -(-n // 2)
    return [body, *made]


def synthesise(parts: list[np.ndarray], tails: list[np.ndarray] | None, first: int, sizes: list[int], low: Taps, high: Taps) -> np.ndarray:
    """A block's samples from its coefficients, the smoothed part and the details by level; other blocks than the first have as many before their own as there are taps.

    ``tails`` are the last ones of the series, for the first of several blocks; None for a series of one block and for later blocks.
    """
    reach, whole = len(low), first == 0 and tails is None

    def both(a: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * len(a) + reach - 2)
        for j, (h, g) in enumerate(zip(low, high, strict=True)):
            out[j : j + 2 * len(a) : 2] += h * a + g * d
        return out

    y, tail = parts[0], tails[0] if tails else None
    for k in range(len(parts) - 1, 0, -1):
        d, n, own = parts[k], sizes[k - 1], first >> (k - 1)
        if whole:
            y = both(y, d)
            np.add.at(y, np.arange(2 * len(d), len(y)) % (2 * len(d)), y[2 * len(d) :])
            y = y[:n]
        elif first:
            # Its places are counted from 2 (own / 2 - reach).
            y = both(y, d)[reach : 2 * len(d)][: n - own + reach]
        else:
            y = both(np.r_[tail, y], np.r_[tails[k], d])[2 * reach : 2 * (reach + len(d))][:n]
            end = both(tail, tails[k])[: 2 * reach]  # from 2 (sizes[k] - reach) on
            tail = end[: len(end) - (2 * sizes[k] - n)][-reach:]
    return y[reach:] if first else y


@dataclass
class Decompose(Transform):
    """Coefficients along a new first axis ``band``: 0 the smoothed series, then the details from the coarsest to the finest; ``dim`` counts the band's coefficients."""

    wavelet: str = "db2"
    level: int = 2
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        if self.level < 1:
            raise ValueError("at least one level is needed")
        keys, dim, level = x.keys(self.dim), self.dim, self.level
        low, high = taps(self.wavelet)
        size, reach = block_size(level, len(low)), len(low) << level
        at, own, last = F.col(dim), F.floor(F.col(dim) / size), F.floor((F.col("n") - 1) / size)
        ahead, first = (own > 0) & (at % size < reach), at < reach
        seen = F.array(own, F.when(ahead, own - 1).otherwise(own), F.when(first, last).otherwise(own), F.when(first, last - 1).otherwise(own))
        rows = x.with_stats(keys, n=F.max(dim) + 1).withColumn("__block", F.explode(F.when(last == 0, F.array(own)).otherwise(F.array_distinct(seen))))
        schema = T.StructType([T.StructField("band", T.LongType()), *[f for f in x.df.schema.fields if f.name in keys], T.StructField(dim, T.LongType()), T.StructField("value", T.DoubleType())])

        def bands(r: dict[str, np.ndarray], block: int, n: int, v: np.ndarray, low: Taps, high: Taps) -> list[np.ndarray]:
            start = block * size
            stop = min(n, start + size + reach)
            place = r[dim] - start
            there, top = (place >= 0) & (r[dim] < stop), r[dim] < reach
            body, head = np.bincount(place[there], v[there], stop - start), np.bincount(r[dim][top], v[top], reach)
            made, sizes = analyse(body, head, start, n, level, low, high), lengths(min(size, n - start), level)
            return [made[0][: sizes[level]], *[m[: sizes[k]] for k, m in enumerate(made[1:], 1)]]

        def run(r: dict[str, np.ndarray], block: int, n: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray | None]:
            made, start = bands(r, block, n, r["value"], low, high), block * size
            known = np.concatenate(bands(r, block, n, r["known"], (1.0,) * len(low), (1.0,) * len(low))) > 0 if "known" in r else None
            own = [(0, level), *[(level + 1 - k, k) for k in range(1, level + 1)]]
            places = {"band": np.repeat([b for b, _ in own], [len(m) for m in made]), dim: np.concatenate([(start >> k) + np.arange(len(m)) for (_, k), m in zip(own, made, strict=True)])}
            return places, np.concatenate(made), known

        return x.to(_by_block(rows.select(*keys, "__block", "n", dim, "value"), keys, (dim,), run, schema), ("band", *x.axes))


def _by_block(rows: DataFrame, keys: Sequence[str], places: Sequence[str], fn: Callable, schema: T.StructType) -> DataFrame:
    """``fn`` of each block's columns ``places`` and ``value``, its number and its series' length gives the places and the values of its rows; without nulls but for ``known``, which is there if a value is null."""
    by, arrow = [*keys, "__block"], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, sizes in blocks.whole_groups(batches, by, 1 << 18):
            firsts = np.cumsum(sizes) - sizes
            columns = {c: t[c].to_numpy() for c in places} | {"value": t["value"].fill_null(0.0).to_numpy()}
            if t["value"].null_count:
                columns["known"] = t["value"].is_valid().to_numpy().astype(float)
            made = [fn({c: v[i : i + m] for c, v in columns.items()}, b, n) for i, m, b, n in zip(firsts, sizes, t["__block"].to_numpy()[firsts].tolist(), t["n"].to_numpy()[firsts].tolist(), strict=True)]
            of = pa.array(np.repeat(firsts, [len(v) for _, v, _ in made]))
            value = pa.array(np.concatenate([v for _, v, _ in made]), mask=~np.concatenate([k for _, _, k in made]) if "known" in columns else None)
            out = {k: t[k].take(of) for k in keys} | {c: pa.array(np.concatenate([p[c] for p, _, _ in made])) for c in made[0][0]} | {"value": value}
            yield from pa.table([out[c] for c in arrow.names], schema=arrow).combine_chunks().to_batches()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


@dataclass
class Reconstruct(Transform):
    """The series from its bands; ``sizes`` (keys, n) has the series' lengths, or n is the length of all."""

    sizes: DataFrame | int
    wavelet: str = "db2"
    level: int = 2
    dim: str = "t"

    def apply(self, x: SignalFrame) -> SignalFrame:
        keys = x.keys("band", self.dim)
        if isinstance(self.sizes, DataFrame):
            sizes = self.sizes.withColumnRenamed("n", "__whole")
            df = x.df.join(sizes, keys) if keys else x.df.join(F.broadcast(sizes))
        else:
            df = x.df.withColumn("__whole", F.lit(self.sizes).cast("long"))
        dim, level = self.dim, self.level
        low, high = taps(self.wavelet)
        size, reach = block_size(level, len(low)), len(low)
        # The level of a band's coefficients: their own block, the next one and the first of several, which the series' end goes on into.
        depth = F.when(F.col("band") == 0, level).otherwise(level + 1 - F.col("band")).cast("int")
        step, n, at = F.call_function("shiftleft", F.lit(1).cast("long"), depth), F.col("__whole"), F.col(dim)
        of, count, several = F.floor(size / step), F.floor((n + step - 1) / step), n > size
        own = F.floor(at / of)
        seen = F.array(own, F.when((at % of >= of - reach) & ((own + 1) * size < n), own + 1).otherwise(own), F.when(at >= count - reach, F.lit(0).cast("long")).otherwise(own))
        rows = df.where(F.col("band").between(0, level) & (at < count)).withColumn("__block", F.explode(F.when(several, F.array_distinct(seen)).otherwise(F.array(own))))
        schema = T.StructType([*[f for f in x.df.schema.fields if f.name in keys], T.StructField(dim, T.LongType()), T.StructField("value", T.DoubleType())])

        def samples(r: dict[str, np.ndarray], block: int, n: int, v: np.ndarray, low: Taps, high: Taps) -> np.ndarray:
            start, sizes, parts, tails = block * size, lengths(n, level), [], []
            for band in range(level + 1):
                k = level if band == 0 else level + 1 - band
                first = (start >> k) - (reach if block else 0)
                stop, end = min(sizes[k], (start + size) >> k), sizes[k] - reach
                mine = r["band"] == band
                place, w = r[dim][mine], v[mine]
                there, behind = (place >= first) & (place < stop), place >= end
                parts.append(np.bincount(place[there] - first, w[there], stop - first))
                if block == 0 and n > size:
                    tails.append(np.bincount(place[behind] - end, w[behind], reach))
            back = lambda a: [a[0], *a[:0:-1]] if a else None
            return synthesise(back(parts), back(tails), start, sizes, low, high)

        def run(r: dict[str, np.ndarray], block: int, n: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray | None]:
            y = samples(r, block, n, r["value"], low, high)
            known = samples(r, block, n, r["known"], (1.0,) * reach, (1.0,) * reach) > 0 if "known" in r else None
            return {dim: block * size + np.arange(len(y))}, y, known

        made = _by_block(rows.select(*keys, "__block", n.alias("n"), "band", dim, "value"), keys, ("band", dim), run, schema)
        return x.to(made, [a for a in x.axes if a != "band"])


@dataclass
class WaveletDecomposition(Transform):
    """Each grid's details times its factor: ``factors`` one per grid of ``electrodes`` channels, or one for all. Further grids stay as they are.

    The smoothed part A is all but the details, so the result is factor x + (1 - factor) A.
    """

    factors: Sequence[float] | float
    wavelet: str = "db2"
    level: int = 2
    electrodes: int = 64
    dim: str = "t"
    channel: str = "channel"

    def apply(self, x: SignalFrame) -> SignalFrame:
        keys = x.keys(self.dim)
        sizes = x.df.groupBy(*keys).agg((F.max(self.dim) + 1).alias("n")) if keys else x.df.agg((F.max(self.dim) + 1).alias("n"))
        bands = Decompose(self.wavelet, self.level, self.dim)(x)
        smooth = Reconstruct(sizes, self.wavelet, self.level, self.dim)(bands.to(bands.df.where("band = 0"))).df.withColumnRenamed("value", "__smooth")
        if isinstance(self.factors, (int, float)):
            factor = F.lit(float(self.factors))
        else:
            factor = F.coalesce(F.try_element_at(F.array(*[F.lit(float(v)) for v in self.factors]), (F.floor(F.col(self.channel) / self.electrodes) + 1).cast("int")), F.lit(1.0))
        return x.to(x.df.join(smooth, list(x.axes)).withColumn("value", factor * F.col("value") + (1 - factor) * F.col("__smooth")))
