"""Recursive and frequency-domain filters.

A biquad is a true recurrence and the notch needs a transform of the whole series. By default series are spread over tasks and a task
works on many of them at once, in Arrow batches: a single series is one task, and its length is bounded by a task's memory.

With ``block`` a single series is spread over tasks too, exactly. A biquad's state is linear in its start, so each block is filtered from a zero
state, the blocks' end states are combined along the series (one row per block), and each block runs again from its true start; a clamp acts
on a pass's output only, so every clamped pass is such a round. The notch adds up each block's share of the Fourier sums of its bins, by chirp
transforms, and subtracts the bins' waves from each block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks
from ..frame import SignalFrame, Transform

#: Values that a task works on at once, if they are not of one series, and series that are filtered together rather than one by one.
SERIES_ROWS, TOGETHER = 1_000_000, 8
#: Samples that a task holds at once of a series in blocks, if they are not of one block.
BLOCK_ROWS = 1 << 18

Section = tuple[float, float, float, float, float]  # b0, b1, b2, a1, a2


def biquad(kind: str, cutoff: float, fs: float, q: float = 0.707) -> Section:
    """Coefficients of the audio cookbook's second-order low or high pass, divided by a0."""
    w = 2 * math.pi * cutoff / fs
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    edge = (1 - c) / 2 if kind == "low" else (1 + c) / 2
    a0 = 1 + alpha
    return edge / a0, (1 - c if kind == "low" else -(1 + c)) / a0, edge / a0, -2 * c / a0, (1 - alpha) / a0


def by_series(x: SignalFrame, dim: str, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> SignalFrame:
    """``fn`` of the values of whole series, one after another, and of the series' lengths, in Arrow batches.

    Rows are dealt out by series and sorted; a task holds SERIES_ROWS values or one series at a time.
    """
    keys = x.keys(dim)
    rows = x.df.select(*keys, dim, "value")
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, sizes in blocks.whole_groups(batches, keys, SERIES_ROWS):
            out = fn(t.column("value").to_numpy(), sizes)
            yield from t.set_column(t.num_columns - 1, "value", pa.array(out)).combine_chunks().to_batches()

    return x.to(rows.mapInArrow(run, rows.schema))


def run_sections(values: list[float], sections: list[Section], clamp: bool) -> list[float]:
    """Each section in turn, causal from a zero state; ``clamp`` limits a pass's output, not its feedback, to [-1, 1]."""
    for b0, b1, b2, a1, a2 in sections:
        x1 = x2 = y1 = y2 = 0.0
        out = []
        for v in values:
            y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(min(max(y, -1.0), 1.0) if clamp else y)
        values = out
    return values


def run_together(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sections: list[Section], clamp: bool) -> np.ndarray:
    """``run_sections`` of many series at once, a sample of each at a time; the shorter ones are filled up at their end."""
    at = np.arange(int(sizes.max()))[:, None]
    there = at < sizes
    x = np.where(there, values[np.minimum(starts + at, len(values) - 1)], 0.0)
    for b0, b1, b2, a1, a2 in sections:
        x1 = x2 = y1 = y2 = np.zeros(len(sizes))
        out = np.empty_like(x)
        for k, v in enumerate(x):
            y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out[k] = np.clip(y, -1.0, 1.0) if clamp else y
        x = out
    flat = np.empty_like(values)
    flat[(starts + at)[there]] = x[there]
    return flat


def filtered(values: np.ndarray, sizes: np.ndarray, sections: list[Section], clamp: bool) -> np.ndarray:
    """Series of like length together, where there are several; else one by one."""
    starts, out = np.cumsum(sizes) - sizes, np.empty_like(values, dtype=float)
    order = np.argsort(sizes, kind="stable")
    k = 0
    while k < len(order):
        to = int(np.searchsorted(sizes[order], 2 * sizes[order[k]], side="right"))
        group = order[k:to]
        k = to
        if len(group) >= TOGETHER:
            own, places = sizes[group], np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in group])
            out[places] = run_together(values[places].astype(float), np.cumsum(own) - own, own, sections, clamp)
        else:
            for g in group:
                place = slice(starts[g], starts[g] + sizes[g])
                out[place] = run_sections(values[place].tolist(), sections, clamp)
    return out


def backwards(sizes: np.ndarray) -> np.ndarray:
    """The places of the values with each series reversed."""
    ends = np.cumsum(sizes)
    return np.repeat(ends - 1, sizes) - (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes))


def scan(x: np.ndarray, section: Section, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section over a block from a state: its output and its end state. Parts of the block run together, and their states are combined as those of blocks are."""
    b0, b1, b2, a1, a2 = section
    m = max(1, math.isqrt(len(x)))
    c = len(x) // m
    parts, z1, z2 = x[: c * m].reshape(c, m), np.zeros(c), np.zeros(c)
    y, response, state = np.empty((c, m)), np.empty((m, 2)), np.eye(2)
    for j in range(m):
        v = parts[:, j]
        y[:, j] = w = b0 * v + z1
        z1, z2 = b1 * v - a1 * w + z2, b2 * v - a2 * w
        response[j] = state[0]
        state = np.stack([state[1] - a1 * state[0], -a2 * state[0]])
    starts, (s1, s2) = np.empty((c, 2)), start
    for k in range(c):
        starts[k] = s1, s2
        s1, s2 = state[0, 0] * s1 + state[0, 1] * s2 + z1[k], state[1, 0] * s1 + state[1, 1] * s2 + z2[k]
    out = np.empty(len(x))
    out[: c * m] = (y + starts @ response.T).ravel()
    for k in range(c * m, len(x)):
        v = x[k]
        out[k] = w = b0 * v + s1
        s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
    return out, np.array([s1, s2])


def cascade(x: np.ndarray, sections: list[Section], start: np.ndarray, clamp: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sections in turn from their states, two numbers each: the output and the end states."""
    ends = np.empty(2 * len(sections))
    for k, s in enumerate(sections):
        x, ends[2 * k : 2 * k + 2] = scan(x, s, start[2 * k : 2 * k + 2])
        if clamp:
            x = np.clip(x, -1.0, 1.0)
    return x, ends


def cascades(x: np.ndarray, sections: list[Section], starts: np.ndarray, clamp: bool) -> tuple[np.ndarray, np.ndarray]:
    """``cascade`` of many blocks of one length, a row each: a sample of all at a time, or one by one where they are few and long."""
    ends = np.empty((len(x), 2 * len(sections)))
    if len(x) ** 2 < x.shape[1]:
        out = np.empty(x.shape)
        for k, v in enumerate(x):
            out[k], ends[k] = cascade(v, sections, starts[k], clamp)
        return out, ends
    x = np.ascontiguousarray(x.T)
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        z1, z2 = starts[:, 2 * k], starts[:, 2 * k + 1]
        y = np.empty_like(x)
        for j, v in enumerate(x):
            y[j] = w = b0 * v + z1
            z1, z2 = b1 * v - a1 * w + z2, b2 * v - a2 * w
        ends[:, 2 * k], ends[:, 2 * k + 1] = z1, z2
        x = np.clip(y, -1.0, 1.0) if clamp else y
    return x.T, ends


def run_blocks(values: np.ndarray, sizes: np.ndarray, sections: list[Section], starts: np.ndarray, clamp: bool) -> tuple[np.ndarray, np.ndarray]:
    """``cascade`` of blocks one after another, each from its row of ``starts``; those of one length together."""
    firsts, out, ends = np.cumsum(sizes) - sizes, np.empty(len(values)), np.empty((len(sizes), 2 * len(sections)))
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        places = firsts[own][:, None] + np.arange(n)
        out[places], ends[own] = cascades(values[places].astype(float), sections, starts[own], clamp)
    return out, ends


def silence(sections: list[Section]) -> np.ndarray:
    """The matrix by which a sample of silence changes the states of an unclamped cascade."""
    return np.stack([cascade(np.zeros(1), sections, e, False)[1] for e in np.eye(2 * len(sections))], axis=1)


def lists_of(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()), type=kind)


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def in_blocks(x: SignalFrame, sections: list[Section], clamp: bool, dim: str, block: int, backwards: bool = False) -> SignalFrame:
    """The cascade with every series spread over tasks by blocks of ``block`` samples; ``backwards`` from the series' ends.

    A round finds the blocks' starting states of one clamped pass, or of the whole cascade where nothing is clamped. The samples are shuffled
    once and stay where they are; only states, a row per block, move on from round to round and are joined to the samples. A task works on
    BLOCK_ROWS samples at once, those of many short blocks together.
    """
    keys = x.keys(dim)
    by = [*keys, "__none", "__block"]
    # With the number given, small blocks aren't put into fewer tasks: a block costs far more than its bytes.
    n_tasks = int(x.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A join loses keys that are null, so they are filled; __none tells which were.
    filled = [F.coalesce(F.col(k), F.lit(0).cast(x.df.schema[k].dataType)).alias(k) for k in keys]
    none = sum((F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(keys)), F.lit(0))
    number, turn = F.floor(F.col(dim) / block), -1 if backwards else 1
    rows = x.df.select(*filled, none.alias("__none"), F.coalesce(number * turn, F.lit(-(1 << 62))).alias("__block"), dim, "value").repartition(n_tasks, *by)
    passes = [1] * len(sections) if clamp else [len(sections)]
    key_fields = [f for f in rows.schema.fields if f.name in by]
    state = T.StructType([*key_fields, T.StructField("n", T.LongType()), T.StructField("starts", T.ArrayType(T.DoubleType())), T.StructField("ends", T.ArrayType(T.DoubleType()))])
    whole = rows.drop("__block").schema
    as_arrow, out_arrow = to_arrow_schema(state), to_arrow_schema(whole)

    def opened(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
        """Whole blocks, their samples in turn, as tables with the blocks' sizes, first places and starting states of ``width`` numbers."""
        for t, sizes in blocks.whole_groups(batches, by, BLOCK_ROWS):
            firsts = np.cumsum(sizes) - sizes
            starts = np.zeros((len(sizes), 0))
            if width:
                starts = matrix_of(t["starts"].take(pa.array(firsts)).combine_chunks(), width)
                t = t.drop_columns(["starts"])
            of, at = np.repeat(np.arange(len(sizes)), sizes), turn * t[dim].to_numpy()
            if not np.all((at[1:] > at[:-1]) | (of[1:] > of[:-1])):
                t = t.take(pa.array(np.lexsort((at, of))))
            yield t, sizes, firsts, starts

    def ends(done: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The blocks' end states of round ``done`` from silence, behind the rounds before it."""
        before, own = sum(passes[:done]), passes[done]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, sizes, firsts, starts in opened(batches, 2 * before):
                _, end = run_blocks(t["value"].to_numpy(), sizes, sections[: before + own], np.hstack([starts, np.zeros((len(sizes), 2 * own))]), clamp)
                at = pa.array(firsts)
                columns = [*[t[k].take(at) for k in by], pa.array(sizes), lists_of(starts, as_arrow.field("starts").type), lists_of(end[:, 2 * before :], as_arrow.field("ends").type)]
                yield from pa.table(columns, schema=as_arrow).combine_chunks().to_batches()

        return run

    def carried(done: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The starting states of round ``done`` from its end states, along each series; a row per block passes through, the blocks of many series at once."""
        before, own = sum(passes[:done]), passes[done]
        step, powers = silence(sections[before : before + own]), {}

        def over(states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            """The states after blocks of silence."""
            kinds, which = np.unique(sizes, return_inverse=True)
            for n in kinds.tolist():
                if n not in powers:
                    powers[n] = np.linalg.matrix_power(step, n)
            if len(kinds) == 1:
                return states @ powers[int(kinds[0])].T
            return np.einsum("kij,kj->ki", np.stack([powers[n] for n in kinds.tolist()])[which], states)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, now = None, None
            for b in batches:
                if not b.num_rows:
                    continue
                firsts = blocks.firsts_of(b, by[:-1])
                lengths = np.diff(np.r_[firsts, b.num_rows])
                series = [b.slice(k, 1).select(by[:-1]).to_pylist() for k in (0, b.num_rows - 1)]
                states = np.zeros((len(firsts), 2 * own))
                if series[0] == last:
                    states[0] = now
                sizes, end, starts = b.column("n").to_numpy(), matrix_of(b.column("ends"), 2 * own), np.empty((b.num_rows, 2 * own))
                for k in range(int(lengths.max())):
                    there = np.flatnonzero(lengths > k)
                    at = firsts[there] + k
                    starts[at] = states[there]
                    states[there] = over(states[there], sizes[at]) + end[at]
                last, now = series[1], states[-1]
                made = lists_of(np.hstack([matrix_of(b.column("starts"), 2 * before), starts]), as_arrow.field("starts").type)
                yield b.set_column(b.schema.get_field_index("starts"), as_arrow.field("starts"), made)

        return run

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, sizes, _, starts in opened(batches, 2 * len(sections)):
            y, _ = run_blocks(t["value"].to_numpy(), sizes, sections, starts, clamp)
            yield from pa.table([*[t[k] for k in keys], t["__none"], t[dim], pa.array(y)], schema=out_arrow).combine_chunks().to_batches()

    seen = rows.sortWithinPartitions(*by)
    for done in range(len(passes)):
        states = seen.mapInArrow(ends(done), state).repartition(*by[:-1]).sortWithinPartitions(*by).mapInArrow(carried(done), state)
        seen = rows.join(states.select(*by, "starts").repartition(n_tasks, *by).hint("merge"), by)
    y = seen.mapInArrow(made, whole)
    return x.to(y.select(*[F.when(F.col("__none").bitwiseAND(1 << i) == 0, F.col(k)).alias(k) for i, k in enumerate(keys)], dim, "value"))


@dataclass
class Sections(Transform):
    """A cascade of biquads along the axis; ``both_ways`` filters again from the end. With ``block`` a series is filtered by many tasks, so many samples in each."""

    sections: list[Section]
    clamp: bool = True
    both_ways: bool = False
    dim: str = "t"
    block: int | None = None

    def apply(self, x: SignalFrame) -> SignalFrame:
        if self.block:
            y = in_blocks(x, self.sections, self.clamp, self.dim, self.block)
            if self.both_ways:
                y = in_blocks(y, self.sections, self.clamp, self.dim, self.block, backwards=True)
            return y
        sections, clamp, both = self.sections, self.clamp, self.both_ways

        def run(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            y = filtered(values, sizes, sections, clamp)
            if both:
                back = backwards(sizes)
                y = filtered(y[back], sizes, sections, clamp)[back]
            return y

        return by_series(x, self.dim, run)


def highpass(cutoff: float, fs: float, order: int = 4, q: float = 0.707, clamp: bool = True, block: int | None = None) -> Sections:
    """``order`` passes of one second-order section."""
    return Sections([biquad("high", cutoff, fs, q)] * order, clamp, block=block)


def lowpass(cutoff: float, fs: float, order: int = 4, q: float = 0.707, clamp: bool = True, block: int | None = None) -> Sections:
    return Sections([biquad("low", cutoff, fs, q)] * order, clamp, block=block)


def bandpass(low: float, high: float, fs: float, order: int = 4, q: float = 0.707, clamp: bool = True, block: int | None = None) -> Sections:
    return Sections([biquad("high", low, fs, q)] * order + [biquad("low", high, fs, q)] * order, clamp, block=block)


@dataclass
class ChunkedSections(Transform):
    """A cascade over chunks of series: ``chunk`` numbers pieces of ``size`` samples of a series along ``dim``.

    Continuous, the filter's state goes on from chunk to chunk, so the result is that of the whole series. Else each chunk starts from silence,
    after ``overlap`` samples of the chunks before it that only warm the filter up.
    """

    sections: list[Section]
    size: int
    clamp: bool = True
    continuous: bool = True
    overlap: int = 0
    both_ways: bool = False
    chunk: str = "chunk"
    dim: str = "t"
    block: int | None = None

    def apply(self, x: SignalFrame) -> SignalFrame:
        if self.chunk not in x.axes:
            raise ValueError(f"no axis {self.chunk!r} among {x.axes}")
        run = Sections(self.sections, self.clamp, self.both_ways, self.dim, self.block)
        at, t = F.col(self.chunk) * self.size + F.col(self.dim), F.col(self.dim)
        if self.continuous:
            y = run(x.to(x.df.withColumn(self.dim, at), x.keys(self.chunk)))
            made = y.df.withColumns({self.chunk: F.floor(t / self.size), self.dim: t % self.size})
        elif self.overlap:
            # Each chunk gets the last samples before it; the first ones have fewer.
            seen = blocks.with_halo(x.df.withColumn(self.dim, at).drop(self.chunk), self.dim, self.overlap, block=self.size)
            ends = x.df.groupBy(*x.keys(self.chunk, self.dim)).agg(F.max(self.chunk).alias("__chunks")) if x.keys(self.chunk, self.dim) else x.df.agg(F.max(self.chunk).alias("__chunks"))
            seen = (seen.join(ends, x.keys(self.chunk, self.dim)) if x.keys(self.chunk, self.dim) else seen.join(F.broadcast(ends))).where(F.col("__block") <= F.col("__chunks"))
            warm = F.least(F.lit(self.overlap), F.col("__block") * self.size)
            y = run(x.to(seen.withColumns({self.chunk: F.col("__block"), self.dim: t - F.col("__block") * self.size + warm})))
            made = y.df.withColumn(self.dim, t - F.least(F.lit(self.overlap), F.col(self.chunk) * self.size)).where(t >= 0)
        else:
            made = run(x).df
        return x.to(made)


def band(freq: float, width: float, fs: float, n: int) -> tuple[int, int]:
    """The first and the last Fourier bin within the band, of ``n`` samples; none where the first is the later one."""
    return max(0, math.ceil((freq - width / 2) * n / fs)), min(math.floor((freq + width / 2) * n / fs), n // 2)


def chirp(x: np.ndarray, a: int, b: int, m: int, n: int) -> np.ndarray:
    """Sums over i of x[i] exp(-2 pi I (a + i) (b + k) / n) for k below ``m``, by one convolution; exponents are reduced as whole numbers first."""
    turn = lambda e: np.exp(-1j * np.pi / n * (e % (2 * n)))
    i, k = np.arange(len(x), dtype=np.int64), np.arange(m, dtype=np.int64)
    size = 1 << (len(x) + m - 1).bit_length()
    kernel = np.zeros(size, complex)
    kernel[:m] = np.conj(turn(k * k))
    kernel[size - len(x) + 1 :] = np.conj(turn(i * i))[:0:-1]
    made = np.fft.ifft(np.fft.fft(x * turn(2 * (b % n) * i + i * i), size) * np.fft.fft(kernel))[:m]
    return made * turn(2 * (a % n) * k + k * k) * turn(np.array(2 * (a * b % n)))


@dataclass
class Notch(Transform):
    """Remove every Fourier bin within ``width`` around ``freq``, edges included. With ``block`` a series is spread over tasks, so many samples and bins in each."""

    freq: float
    width: float = 2.0
    fs: float = 2048.0
    dim: str = "t"
    block: int | None = None

    def apply(self, x: SignalFrame) -> SignalFrame:
        freq, width, fs = self.freq, self.width, self.fs
        if self.block:
            one = SignalFrame(x.df.withColumn("__series", F.lit(0).cast("long")), ("__series", *x.axes))
            return self._in_blocks(x, self.block) if x.keys(self.dim) else x.to(self._in_blocks(one, self.block).df)

        def run(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            starts, out = np.cumsum(sizes) - sizes, values.astype(float)
            for n in np.unique(sizes):
                lo, hi = band(freq, width, fs, int(n))
                if lo <= hi:
                    places = starts[sizes == n][:, None] + np.arange(n)
                    bins = np.fft.rfft(values[places])
                    bins[:, :lo], bins[:, hi + 1 :] = 0, 0
                    out[places] -= np.fft.irfft(bins, n)
            return out

        return by_series(x, self.dim, run)

    def _in_blocks(self, x: SignalFrame, block: int) -> SignalFrame:
        freq, width, fs, dim, keys = self.freq, self.width, self.fs, self.dim, x.keys(self.dim)
        by = [*keys, "__block"]
        rows = x.with_stats(keys, n=F.max(dim) + 1).select(*keys, F.floor(F.col(dim) / block).alias("__block"), dim, "value", "n")
        bins_schema = T.StructType([*[f for f in rows.schema.fields if f.name in keys], *[T.StructField(c, t) for c, t in (("k", T.LongType()), ("re", T.DoubleType()), ("im", T.DoubleType()))]])
        waves_schema = x.df.select(*keys, dim, "value").schema
        bins_arrow, waves_arrow = to_arrow_schema(bins_schema), to_arrow_schema(waves_schema)

        def sums(t: pa.Table) -> pa.Table:
            """What the block adds to the Fourier sums of the band."""
            t = t.sort_by(dim)
            n, lo = t["n"][0].as_py(), 0
            lo, hi = band(freq, width, fs, n)
            made = [chirp(t["value"].to_numpy(), t[dim][0].as_py(), k, min(block, hi + 1 - k), n) for k in range(lo, hi + 1, block)]
            c = np.concatenate(made) if made else np.zeros(0, complex)
            return pa.table([*[pa.array(np.full(len(c), t[k][0].as_py(), np.int64)) for k in keys], pa.array(lo + np.arange(len(c))), pa.array(c.real), pa.array(c.imag)], schema=bins_arrow)

        def waves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The wave of a run of bins over a block, turned round."""
            for b in batches:
                for r in b.to_pylist():
                    n, bins = r["n"], sorted(r["bins"], key=lambda v: v["k"])
                    weight = np.array([1 if v["k"] == 0 or 2 * v["k"] == n else 2 for v in bins]) / n
                    y = chirp(weight * np.array([v["re"] - 1j * v["im"] for v in bins]), bins[0]["k"], r["first"], r["size"], n).real
                    columns = [pa.array(np.full(len(y), r[k], np.int64)) for k in keys]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(r["first"] + np.arange(len(y))), pa.array(-y)], schema=waves_arrow)

        bins = rows.groupBy(*by).applyInArrow(sums, bins_schema).groupBy(*keys, "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        # Bins lie without gaps, so a run of them has ``block`` at most.
        runs = bins.groupBy(*keys, F.floor(F.col("k") / block).alias("__run")).agg(F.collect_list(F.struct("k", "re", "im")).alias("bins"))
        parts = rows.groupBy(*by).agg(F.min(dim).alias("first"), F.count("*").alias("size"), F.first("n").alias("n"))
        made = parts.join(runs, keys).select(*keys, "first", "size", "n", "bins").mapInArrow(waves, waves_schema)
        return x.to(x.df.select(*keys, dim, "value").unionByName(made).groupBy(*keys, dim).agg(F.sum("value").alias("value")))


def spectral_interpolation(freq: float, fs: float, bandwidth: float = 2.0, harmonics: int = 3) -> list[Notch]:
    """A notch at the frequency and each harmonic, for ``Compose``."""
    return [Notch(freq * k, bandwidth, fs) for k in range(1, harmonics + 1)]
