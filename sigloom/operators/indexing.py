"""Indexing by coordinates, masks and whole index expressions, with numpy's rules for the resulting axes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from . import blocks
from .shape import Index
from ..frame import SignalFrame, Transform


def _placed(x: SignalFrame, dims: Sequence[str], name: str) -> list[str]:
    """The axes with ``dims`` merged into ``name``: in their place where they are neighbours, else first."""
    at = sorted(x.axes.index(d) for d in dims)
    rest = x.keys(*dims)
    first = at[0] if at[-1] - at[0] == len(at) - 1 else 0
    return [*rest[:first], name, *rest[first:]]


@dataclass
class IndexPairs(Transform):
    """The values at coordinates given axis by axis, as lists of one length or as a table: place k of the new axis has the k-th coordinates.

    A table has a column per axis and ``pos``, the place; it is joined, so it may be as large as the signal. Negative places count from the end.
    """

    places: dict[str, Sequence[int]] | DataFrame
    name: str | None = None

    def apply(self, x: SignalFrame) -> SignalFrame:
        if isinstance(self.places, DataFrame):
            asked, dims = self.places, [c for c in self.places.columns if c != "pos"]
        else:
            dims = list(self.places)
            if len({len(v) for v in self.places.values()}) != 1:
                raise ValueError("the lists of places differ in length")
            rows = [(k, *map(int, v)) for k, v in enumerate(zip(*self.places.values(), strict=True))]
            asked = x.df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` long" for c in ("pos", *dims)))
        dims = [x.axis(d) for d in dims]
        asked = asked.toDF(*[c if c == "pos" else x.axis(c) for c in asked.columns])
        if not isinstance(self.places, DataFrame) and any(v < 0 for p in self.places.values() for v in p):
            sizes = x.df.agg(*[(F.max(d) + 1).alias(f"__n_{d}") for d in dims])
            asked = asked.join(F.broadcast(sizes)).select("pos", *[F.when(F.col(d) < 0, F.col(d) + F.col(f"__n_{d}")).otherwise(F.col(d)).alias(d) for d in dims])
        name = self.name or dims[0]
        hit = x.df.join(asked.withColumnRenamed("pos", "__pos"), dims).drop(*dims)
        return x.to(hit.withColumnRenamed("__pos", name), _placed(x, dims, name))


def numbered(kept: DataFrame, order: str, block: int = blocks.BLOCK) -> DataFrame:
    """Add ``pos``, the rows' place in ``order``, a whole number. Blocks are counted first and their counts added up, one row each; no task orders all rows."""
    rows = kept.withColumn("__block", F.floor(F.col(order) / block))
    counts = rows.groupBy("__block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__block").orderBy(order)) - 1
    return rows.withColumn("__within", within).join(counts.select("__block", before.alias("__before")), "__block").withColumn("pos", F.col("__before") + F.col("__within")).drop("__block", "__within", "__before")


@dataclass
class IndexMask(Transform):
    """The values where a mask holds, numbered anew in row-major order along one axis in place of the mask's.

    The mask is a list of truth values along ``dim``, or a signal whose axes are some of this one's and whose values other than 0 hold.
    """

    mask: Sequence[bool] | SignalFrame
    dim: str = "t"
    name: str | None = None
    block: int = blocks.BLOCK
    makes_dim = True

    def apply(self, x: SignalFrame) -> SignalFrame:
        if isinstance(self.mask, SignalFrame):
            dims, kept = list(self.mask.axes), self.mask.df.where("value <> 0").drop("value")
            if lacking := set(dims) - set(x.axes):
                raise ValueError(f"no axis {sorted(lacking)} among {x.axes}")
            sizes = self.mask.df.agg(*[(F.max(d) + 1).alias(f"__n_{d}") for d in dims])
            flat = reduce(lambda a, d: a * F.col(f"__n_{d}") + F.col(d), dims[1:], F.col(dims[0]))
            kept = kept.join(F.broadcast(sizes)).select(*dims, flat.alias("__flat"))
            kept = numbered(kept, "__flat", self.block).drop("__flat")
        else:
            dims = [x.axis(self.dim)]
            kept = x.df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(i for i, v in enumerate(self.mask) if v)], f"`{dims[0]}` long, pos long")
        return IndexPairs(kept, self.name or dims[0])(x)


@dataclass
class At(Transform):
    """A whole index expression, as ``x[key]`` of an array: numbers, slices, one Ellipsis, lists and lists of truth values.

    Several lists, and numbers beside a list, are coordinates that belong together; a lone list gathers along its axis.
    """

    key: tuple | int | slice | list

    def apply(self, x: SignalFrame) -> SignalFrame:
        key = list(self.key) if isinstance(self.key, tuple) else [self.key]
        if sum(k is Ellipsis for k in key) > 1 or len(key) - (Ellipsis in [k for k in key if k is Ellipsis]) > len(x.axes):
            raise IndexError(f"too many indices for the axes {x.axes}")
        if any(k is Ellipsis for k in key):
            at = next(i for i, k in enumerate(key) if k is Ellipsis)
            key[at : at + 1] = [slice(None)] * (len(x.axes) - len(key) + 1)
        key += [slice(None)] * (len(x.axes) - len(key))
        of: dict[str, list | int] = {}
        axes, y = x.axes, x
        for dim, k in zip(axes, key, strict=True):
            if isinstance(k, slice):
                y = y if k == slice(None) else Index(k, dim)(y)
            elif isinstance(k, int) and not isinstance(k, bool):
                of[dim] = k
            else:
                k = [bool(v) if str(v) in ("True", "False") else int(v) for v in k]
                of[dim] = [i for i, v in enumerate(k) if v] if k and all(isinstance(v, bool) for v in k) else k
        lists = [v for v in of.values() if isinstance(v, list)]
        if not lists or len(of) == 1:
            for dim, k in of.items():
                y = Index(k, dim)(y)
            return y
        n = max(map(len, lists))
        if any(len(v) not in (1, n) for v in lists):
            raise IndexError("the lists of places differ in length")
        places = {d: [v] * n if isinstance(v, int) else v * n if len(v) == 1 else v for d, v in of.items()}
        return IndexPairs(places, next(d for d, v in of.items() if isinstance(v, list)))(y)
