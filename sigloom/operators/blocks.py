"""Long series in blocks: what a block needs of its neighbours is copied to it, so no task holds or sorts a whole series.

Axes count from 0 without gaps; a block is BLOCK places of an axis.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

BLOCK = 65_536


def _each(first: Column, last: Column) -> Column:
    """One row for each whole number from first to last."""
    first, last = first.cast("long"), last.cast("long")
    return F.explode(F.when(first == last, F.array(first)).when(first < last, F.sequence(first, last)).otherwise(F.array().cast("array<long>")))


def with_halo(df: DataFrame, dim: str, before: int, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Add ``__block``: each row is in its own block and in those that see it among the ``before`` places before them or the ``after`` places behind them."""
    at = F.col(dim)
    return df.withColumn("__block", _each(F.greatest(F.lit(0), F.floor((at - after) / block)), F.floor((at + before) / block)))


def own(df: DataFrame, dim: str, block: int = BLOCK) -> DataFrame:
    """The rows without the copies that blocks hold of their neighbours'."""
    return df.where(F.floor(F.col(dim) / block) == F.col("__block")).drop("__block")


def along(keys: Sequence[str], dim: str) -> WindowSpec:
    """The rows of a series within their block."""
    return Window.partitionBy(*keys, "__block").orderBy(dim)


def window_span(dim: str, size: int, stride: int) -> tuple[Column, Column]:
    """The first and the last window that hold a sample; no window does where the first is the later one."""
    at = F.col(dim)
    return F.greatest(F.lit(0), F.ceil((at - (size - 1)) / stride)), F.floor(at / stride)


def windows_of_block(stride: int, block: int = BLOCK) -> int:
    return max(1, block // stride)


def with_window_blocks(df: DataFrame, dim: str, size: int, stride: int, block: int = BLOCK) -> DataFrame:
    """Add ``__block``, a run of about ``block`` / ``stride`` windows: a sample is in all blocks whose windows hold it, so every window lies in one block."""
    (first, last), n = window_span(dim, size, stride), windows_of_block(stride, block)
    none = F.when(first > last, F.lit(-1)).otherwise(F.floor(last / n))
    return df.withColumn("__block", _each(F.floor(first / n), none))


def groups_of(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``columns`` as one table per group; only one group and one batch are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        changed = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            changed |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            now = tuple(k[lo] for k in keys)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def firsts_of(rows: pa.Table | pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """The places where groups of rows begin, sorted by ``columns``."""
    changed = np.zeros(max(0, rows.num_rows - 1), bool)
    for k in columns:
        c = rows.column(k)
        c = c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)
        changed |= c[1:] != c[:-1]
    return np.r_[0, np.flatnonzero(changed) + 1]


def whole_groups(batches: Iterator[pa.RecordBatch], columns: Sequence[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``columns`` as tables of whole groups, with the groups' sizes; ``least`` rows or one group are held at a time."""
    held, n, most = [], 0, least
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            t = pa.Table.from_batches(held)
            firsts = firsts_of(t, columns)
            last = int(firsts[-1])  # the last group may go on
            if last:
                yield t.slice(0, last), np.diff(firsts)
            held, n = t.slice(last).to_batches(), t.num_rows - last
            most = max(least, 2 * n)
    if n:
        t = pa.Table.from_batches(held)
        yield t, np.diff(np.r_[firsts_of(t, columns), n])
