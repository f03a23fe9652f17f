"""Dense array files as signals, read in place: ``.npy`` files and folders of uncompressed chunks.

A read is planned from the header alone: one partition per block of the time axis, which seeks to its runs of values. Blocks that a pushed filter on
time rules out aren't opened. A folder of chunks is also written here, a file per block and task, so neither way passes values through the driver.
Paths are of any file system that pyarrow knows and all executors reach.
"""

from __future__ import annotations

import ast
import json
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..frame import SignalFrame

#: Values of a partition, if its block isn't given, and of an Arrow batch.
VALUES, BATCH = 4_194_304, 262_144
#: Fixed values of the formats: the mark of a .npy file, and the name of a chunk folder's description.
MAGIC, DESCRIPTION = b"\x93NUMPY", ".zarray"


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Layout:
    """Where an array's values lie: pieces of ``chunks`` places per axis, each in C order (``fortran``: reversed), behind ``offset`` bytes of its file."""

    path: str
    shape: tuple[int, ...]
    dtype: str
    chunks: tuple[int, ...]
    offset: int = 0
    fortran: bool = False
    separator: str | None = None
    fill: float = 0.0

    @staticmethod
    def of(path: str) -> Layout:
        """From a .npy file's header, or a chunk folder's description."""
        fs, at = open_path(path)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            with fs.open_input_stream(f"{at}/{DESCRIPTION}") as f:
                told = json.loads(f.read())
            if told.get("compressor") or told.get("filters"):
                raise ValueError(f"{path} is compressed or filtered; only plain chunks can be read in place")
            return Layout(path, tuple(told["shape"]), told["dtype"], tuple(told["chunks"]), 0, told.get("order") == "F", told.get("dimension_separator", "."), float(told.get("fill_value") or 0))
        with fs.open_input_file(at) as f:
            head = f.read(12)
            if head[:6] != MAGIC:
                raise ValueError(f"{path} is no array file")
            size, start = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
            f.seek(start)
            told = ast.literal_eval(f.read(size).decode("latin1"))
        shape = tuple(told["shape"])
        return Layout(path, shape, told["descr"], shape, start + size, told["fortran_order"])

    def file(self, chunk: tuple[int, ...]) -> str:
        at = open_path(self.path)[1]
        return at if self.separator is None else f"{at}/{self.separator.join(map(str, chunk))}"

    def read(self, axis: int, first: int, last: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(places per axis, values) of the part with ``first`` <= place < ``last`` along an axis, a run of BATCH values at most at a time."""
        fs, _ = open_path(self.path)
        kind = np.dtype(self.dtype)
        grid = [range(-(-n // max(1, c))) for n, c in zip(self.shape, self.chunks, strict=True)]
        if 0 in self.shape or first >= last:
            return
        grid[axis] = range(first // self.chunks[axis], (last - 1) // self.chunks[axis] + 1)
        for chunk in np.ndindex(*map(len, grid)):
            chunk = tuple(g[k] for g, k in zip(grid, chunk, strict=True))
            start = [k * c for k, c in zip(chunk, self.chunks, strict=True)]
            part = [range(c) if j != axis else range(max(0, first - s), min(c, last - s)) for j, (s, c) in enumerate(zip(start, self.chunks, strict=True))]
            part = [range(p.start, min(p.stop, n - s)) for p, s, n in zip(part, start, self.shape, strict=True)]
            name, order = self.file(chunk), range(len(self.shape))[:: -1 if self.fortran else 1]
            there = self.separator is None or fs.get_file_info(name).type == pafs.FileType.File
            source = fs.open_input_file(name) if there else None
            try:
                # Trailing axes that are whole lie in one run with the part of the axis before them.
                axes, run, k = list(order), 1, len(order) - 1
                while k > 0 and len(part[axes[k]]) == self.chunks[axes[k]]:
                    run *= self.chunks[axes[k]]
                    k -= 1
                outer, inner = axes[:k], axes[k:]
                strides = {a: math.prod(self.chunks[b] for b in axes[i + 1 :]) for i, a in enumerate(axes)}
                many = part[inner[0]]
                step = max(1, BATCH // run)
                for lead in np.ndindex(*[len(part[a]) for a in outer]):
                    base = sum(part[a][v] * strides[a] for a, v in zip(outer, lead, strict=True))
                    for lo in range(many.start, many.stop, step):
                        hi = min(many.stop, lo + step)
                        count = (hi - lo) * run
                        if source:
                            source.seek(self.offset + (base + lo * strides[inner[0]]) * kind.itemsize)
                            values = np.frombuffer(source.read(count * kind.itemsize), kind)
                        else:
                            values = np.full(count, self.fill, kind)
                        sizes = [hi - lo, *[self.chunks[a] for a in inner[1:]]]
                        idx = np.unravel_index(np.arange(count), sizes)
                        places: list[np.ndarray] = [np.zeros(0)] * len(self.shape)
                        for a, v in zip(outer, lead, strict=True):
                            places[a] = np.full(count, start[a] + part[a][v])
                        for i, a in enumerate(inner):
                            places[a] = idx[i] + start[a] + (lo if i == 0 else 0)
                        yield places, values.astype(float)
            finally:
                if source:
                    source.close()


@dataclass
class Block(InputPartition):
    first: int
    last: int

    def __post_init__(self):
        super().__init__((self.first, self.last))


@dataclass
class ArrayReader(DataSourceReader):
    layout: Layout
    axes: list[str]
    time: str
    block: int
    bounds: tuple[float, float] = field(default=(0, math.inf))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons with the time axis decide which blocks are read; Spark checks them once more on the rows."""
        lo, hi = self.bounds
        for f in filters:
            if getattr(f, "attribute", None) == (self.time,):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    lo = max(lo, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    hi = min(hi, f.value + (not isinstance(f, LessThan)))
                if isinstance(f, In) and f.value:
                    lo, hi = max(lo, min(f.value)), min(hi, max(f.value) + 1)
            yield f
        self.bounds = (lo, hi)

    def partitions(self) -> list[Block]:
        n, (lo, hi) = self.layout.shape[self.axes.index(self.time)], self.bounds
        first, last = max(0, int(lo)), int(min(n, hi))
        blocks = [Block(max(first, k), min(last, k + self.block)) for k in range(first // self.block * self.block, last, self.block)]
        return blocks or [Block(0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        for places, values in self.layout.read(self.axes.index(self.time), partition.first, partition.last):
            yield pa.RecordBatch.from_arrays([*[pa.array(p.astype(np.int64)) for p in places], pa.array(values)], names=[*self.axes, "value"])


class ArraySource(DataSource):
    """Options: path, axes (names in the array's order, by commas), time (the axis to split by, the last if it isn't given), block (its places per partition)."""

    @classmethod
    def name(cls) -> str:
        return "sigloom_array"

    def _axes(self) -> list[str]:
        return [a.strip() for a in self.options["axes"].split(",")]

    def schema(self) -> str:
        return ", ".join(f"`{a}` long" for a in self._axes()) + ", value double"

    def reader(self, schema) -> ArrayReader:
        layout, axes = Layout.of(self.options["path"]), self._axes()
        if len(axes) != len(layout.shape):
            raise ValueError(f"{len(axes)} names for {len(layout.shape)} axes")
        time = self.options.get("time", axes[-1])
        at = axes.index(time)
        per_place = max(1, math.prod(layout.shape) // max(1, layout.shape[at]))
        block = int(self.options.get("block", max(1, VALUES // per_place)))
        if layout.separator:  # whole chunks
            block = -(-block // layout.chunks[at]) * layout.chunks[at]
        return ArrayReader(layout, axes, time, block)


def read_array(spark: SparkSession, path: str, axes: tuple[str, ...] = ("channel", "t"), time: str = "t", block: int | None = None, fs: float | None = None) -> SignalFrame:
    """An array file or folder as a signal. The session's filter pushdown to Python sources is switched on, which the reader needs for filters on ``time``."""
    spark.dataSource.register(ArraySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(ArraySource.name()).option("path", path).option("axes", ",".join(axes)).option("time", time)
    return SignalFrame((reader.option("block", block) if block else reader).load(), axes, fs)


def write_chunks(x: SignalFrame, path: str, block: int = 65_536, dim: str = "t", dtype: str = "<f8") -> Layout:
    """Write a signal as a folder of uncompressed chunks: all places of the other axes and ``block`` of ``dim`` in a file, which one task makes. Places without a value are NaN.

    A chunk has its final name only when it is whole; the description comes last, so an unfinished folder can't be read.
    """
    sizes = x.df.agg(*[(F.max(a) + 1).alias(a) for a in x.axes]).first()
    shape = tuple(int(sizes[a] or 0) for a in x.axes)
    at = x.axes.index(dim)
    chunks = tuple(min(block, max(1, n)) if k == at else max(1, n) for k, n in enumerate(shape))
    layout, axes, size = Layout(path, shape, dtype, chunks, separator="."), list(x.axes), chunks[at]
    fs, root = open_path(path)
    fs.create_dir(root, recursive=True)

    def put(t: pa.Table) -> pa.Table:
        k = t[dim][0].as_py() // size
        made = np.full(chunks, np.nan, np.dtype(dtype))
        made[tuple(t[a].to_numpy() - (k * size if a == dim else 0) for a in axes)] = t["value"].to_numpy(zero_copy_only=False)
        own, _ = open_path(path)
        name = layout.file(tuple(k if j == at else 0 for j in range(len(chunks))))
        content, part = made.tobytes(), f"{name}.{uuid.uuid4().hex}.part"
        with own.open_output_stream(part) as f:
            f.write(content)
        own.move(part, name)  # a task that runs twice puts the same bytes there
        return pa.table({"bytes": [len(content)]})

    n_bytes = x.df.select(*axes, "value").groupBy(F.floor(F.col(dim) / size).alias("__block")).applyInArrow(put, "bytes long").agg(F.sum("bytes")).first()[0]
    told = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "compressor": None, "filters": None, "order": "C", "fill_value": "NaN", "dimension_separator": "."}
    with fs.open_output_stream(f"{root}/{DESCRIPTION}") as f:
        f.write(json.dumps(told | {"bytes": n_bytes}).encode())
    return layout
