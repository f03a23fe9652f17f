"""Datasets: modalities aligned per task, a centre-out split, Parquet storage and windowed reads.

A recording table has task, the modality's axes, t and value.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..frame import SignalFrame, signal

SPLITS = ("train", "test", "val")


def align_modalities(modalities: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per task, every modality that has it is cut to the shortest one's length."""
    lengths = None
    for name, df in modalities.items():
        one = df.groupBy("task").agg((F.max("t") + 1).alias("n"))
        lengths = one if lengths is None else lengths.unionByName(one)
    least = lengths.groupBy("task").agg(F.min("n").alias("n_min"))
    return {name: df.join(least, "task").where(F.col("t") < F.col("n_min")).drop("n_min") for name, df in modalities.items()}


def center_split(df: DataFrame, keys: list[str], test_ratio: float = 0.2, val_ratio: float = 0.2, dim: str = "t") -> DataFrame:
    """Add ``split`` and ``seam`` and number ``dim`` anew per split: the centre is test, the centre of the test part is val, the joined edges are train.

    ``seam`` marks the first sample after a cut, so windows over it can be left out.
    """
    if not (0 <= test_ratio <= 1 and 0 <= val_ratio <= 1):
        raise ValueError("ratios lie between 0 and 1")
    keys = list(keys)
    sizes = df.groupBy(*keys).agg((F.max(dim) + 1).alias("n"))
    t, n = F.col(dim), F.col("n")
    mid, half = F.floor(n / 2), F.floor(n * float(test_ratio) / 2)
    m = 2 * half
    u, vmid, vhalf = t - (mid - half), F.floor(m / 2), F.floor(m * float(val_ratio) / 2)
    in_test = (t >= mid - half) & (t < mid + half)
    in_val = in_test & (u >= vmid - vhalf) & (u < vmid + vhalf)
    split = F.when(in_val, "val").when(in_test, "test").otherwise("train")
    at = F.when(in_val, u - (vmid - vhalf)).when(in_test & (u < vmid), u).when(in_test, u - 2 * vhalf).when(t < mid, t).otherwise(t - m)
    seam = F.when(in_val, False).when(in_test, (vhalf > 0) & (u == vmid + vhalf)).otherwise((half > 0) & (t == mid + half))
    out = (df.join(sizes, keys) if keys else df.join(F.broadcast(sizes))).select(*[c for c in df.columns if c != dim], split.alias("split"), seam.alias("seam"), at.cast("long").alias("__at"))
    return out.withColumnRenamed("__at", dim)


def split_axis(x: SignalFrame, dim: str | None = None, test_ratio: float = 0.2, val_ratio: float = 0.2) -> DataFrame:
    """``center_split`` of a signal's whole slices along an axis, the first by default. The ratios together are 1 at most."""
    if test_ratio + val_ratio > 1:
        raise ValueError("the ratios add up to more than 1")
    return center_split(x.df, [], test_ratio, val_ratio, dim or x.axes[0])


def split_signals(signals: dict[str, SignalFrame], dim: str | None = None, test_ratio: float = 0.2, val_ratio: float = 0.2) -> dict[str, DataFrame]:
    return {name: split_axis(x, dim, test_ratio, val_ratio) for name, x in signals.items()}


def modality(tasks: SignalFrame | dict[str, SignalFrame], transform: Callable[[SignalFrame], SignalFrame] | None = None) -> DataFrame:
    """A recording table (task, axes, value) of one signal, as task "default", or of a signal per task; each is transformed first."""
    named = tasks if isinstance(tasks, dict) else {"default": tasks}
    made = {name: transform(x) if transform else x for name, x in named.items()}
    if len({x.axes for x in made.values()}) != 1:
        raise ValueError("the tasks' axes differ")
    return reduce(DataFrame.unionByName, [x.df.select(F.lit(name).alias("task"), *x.axes, "value") for name, x in made.items()])


@dataclass
class DatasetCreator:
    """Align, split and write ``split=/modality=/task=`` Parquet with a metadata table beside it."""

    modalities: dict[str, DataFrame]
    path: str
    sampling_frequency: float = 2048.0
    #: The first modality's, if none are given.
    tasks_to_use: list[str] = field(default_factory=list)
    test_ratio: float = 0.2
    val_ratio: float = 0.2
    #: Samples of a series that are stored together.
    chunk: int = 65_536

    def create(self) -> None:
        first = next(iter(self.modalities.values())).select("task").distinct()
        used = {n: df.where(F.col("task").isin(self.tasks_to_use)) if self.tasks_to_use else df.join(first, "task", "left_semi") for n, df in self.modalities.items()}
        for name, df in align_modalities(used).items():
            axes = [c for c in df.columns if c not in ("task", "t", "value")]
            rows = center_split(df, ["task"], self.test_ratio, self.val_ratio).withColumns({"value": F.col("value").cast("float"), "modality": F.lit(name)})
            rows = rows.repartition("split", "task", F.floor(F.col("t") / self.chunk)).sortWithinPartitions("split", "task", *axes, "t")
            # Axes differ between modalities, so each has its own table; its folder is the first partition level.
            rows.drop("modality").write.mode("overwrite").partitionBy("split", "task").parquet(f"{self.path}/modality={name}")
        spark = next(iter(self.modalities.values())).sparkSession
        tasks = self.tasks_to_use or [r[0] for r in first.orderBy("task").collect()]  # names of recordings
        meta = {"sampling_frequency": self.sampling_frequency, "tasks": tasks, "modalities": list(self.modalities), "dims": {n: [c for c in df.columns if c not in ("task", "value")] for n, df in self.modalities.items()}}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_meta").first()[0])


def read_split(spark: SparkSession, path: str, modality: str, split: str) -> DataFrame:
    """One split of one modality; other partitions aren't read. Unknown names are errors."""
    meta = read_meta(spark, path)
    if split not in SPLITS or modality not in meta["modalities"]:
        raise ValueError(f"no split {split!r} or no modality {modality!r}")
    axes = [d for d in meta["dims"][modality] if d != "t"]
    schema = ", ".join(f"{a} long" for a in axes) + (", " if axes else "") + "value float, seam boolean, t long, split string, task string"
    return spark.read.schema(schema).parquet(f"{path}/modality={modality}").where(F.col("split") == split)


def _lengths(df: DataFrame, size: int, recording: str, strict: bool) -> DataFrame:
    """(recording, n) of the recordings that hold a window; ``strict``: the query fails if there is none."""
    lengths = df.groupBy(recording).agg((F.max("t") + 1).alias("n"))
    enough = lengths.where(F.col("n") >= size)
    if not strict:
        return enough
    # One row that fails or goes; a union, as a join with no rows wouldn't look at it.
    told = F.when(F.coalesce(F.max("n"), F.lit(0)) < size, F.raise_error(F.lit(f"no recording is long enough for windows of {size} samples")).cast("long")).otherwise(F.lit(None).cast("long"))
    guard = lengths.agg(told.alias("n")).where("n is not null").select(F.lit(None).cast(df.schema[recording].dataType).alias(recording), "n")
    return enough.unionByName(guard)


def window_starts(df: DataFrame, size: int, stride: int, recording: str = "task", strict: bool = False) -> DataFrame:
    """(window_id, recording, start): every full window, numbered by recording in order of name. ``strict``: it is an error if there is none.

    A recording's first id is a running sum over one row per recording.
    """
    lengths = _lengths(df, size, recording, strict)
    counts = lengths.withColumn("k", F.floor((F.col("n") - size) / stride) + 1)
    first = F.coalesce(F.sum("k").over(Window.orderBy(recording).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("first", first).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))).select((F.col("first") + F.col("i")).alias("window_id"), recording, (F.col("i") * stride).alias("start"))


#: Odd multipliers that scramble a draw's number.
_SCRAMBLE = (2_654_435_761, 1_597_334_677)


def random_starts(df: DataFrame, size: int, n_windows: int, seed: int = 0, recording: str = "task", strict: bool = False) -> DataFrame:
    """``n_windows`` uniform draws over all valid starts of all recordings; the seed alone decides them.

    A draw is a number in [0, 1), and a recording a part of it. Both are cut into ``n_windows`` equal buckets, so draws meet the few recordings of their bucket.
    """
    lengths = _lengths(df, size, recording, strict)
    spans = lengths.withColumn("k", F.col("n") - size + 1)
    # One row per recording.
    spans = spans.withColumns({"hi": F.sum("k").over(Window.orderBy(recording)), "total": F.sum("k").over(Window.partitionBy(F.lit(0)))}).withColumn("lo", F.col("hi") - F.col("k"))
    first, last = (F.floor(F.col(c) * float(n_windows) / F.col("total")) for c in ("lo", "hi"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(first, F.least(last, F.lit(n_windows - 1)))))
    u = F.lit((seed * 7_919 + 1) % (1 << 31)).cast("long") + F.col("id")
    for m in _SCRAMBLE:
        u = F.pmod(u % F.lit(1 << 31) * F.lit(m), F.lit(1 << 32))
        u = u.bitwiseXOR(F.shiftright(u, 15))
    draws = df.sparkSession.range(n_windows).select(F.col("id").alias("window_id"), (u / float(1 << 32)).alias("u")).withColumn("bucket", F.floor(F.col("u") * n_windows))
    # Neighbouring buckets too, as a recording's ends are rounded.
    draws = draws.withColumn("bucket", F.explode(F.array_distinct(F.array(F.greatest(F.col("bucket") - 1, F.lit(0)), "bucket", F.least(F.col("bucket") + 1, F.lit(n_windows - 1))))))
    hit = draws.join(spans, "bucket").withColumn("pos", F.floor(F.col("u") * F.col("total"))).where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
    return hit.select("window_id", recording, (F.col("pos") - F.col("lo")).alias("start")).distinct()


def fetch_windows(df: DataFrame, starts: DataFrame, size: int, recording: str = "task", block: int | None = None) -> DataFrame:
    """The samples of each window, t counted from its start. The range becomes an equal join on blocks of ``size`` samples.

    With ``block`` the samples have a column ``block`` already, of so many samples each: those of a ``BucketedStore`` aren't shuffled.
    """
    of = block or size
    asks = starts.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / of), F.floor((F.col("start") + size - 1) / of))))
    rows = df if block else df.withColumn("block", F.floor(F.col("t") / of))
    hit = rows.join(asks, [recording, "block"]).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + size))
    return hit.withColumn("t", F.col("t") - F.col("start")).drop("block")


@dataclass
class BucketedStore:
    """Recordings bucketed by (task, block), so that windows are fetched without a shuffle of the samples.

    A table of the session's catalog over a folder: ``open`` makes the table known to a new session.
    """

    spark: SparkSession
    table: str
    path: str
    block: int = 65_536
    buckets: int = 64

    def write(self, df: DataFrame) -> None:
        """(task, axes, t, value): a block is in one bucket, sorted."""
        axes = [c for c in df.columns if c not in ("task", "t", "value")]
        rows = df.withColumn("block", F.floor(F.col("t") / self.block)).repartition(self.buckets, "task", "block")
        rows.write.mode("overwrite").option("path", self.path).bucketBy(self.buckets, "task", "block").sortBy("task", "block", *axes, "t").format("parquet").saveAsTable(self.table)

    def open(self, schema: str) -> DataFrame:
        """The table of a folder written before; ``schema`` is that of its columns, ``block`` too."""
        self.spark.sql(f"create table if not exists {self.table} ({schema}) using parquet clustered by (task, block) into {self.buckets} buckets location '{self.path}'")
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def fetch(self, starts: DataFrame, size: int) -> DataFrame:
        """The samples of the windows (window_id, task, start). Only the windows are shuffled, to the samples' buckets, or broadcast where they are few."""
        return fetch_windows(self.read(), starts, size, block=self.block)


def dense_batches(x: SignalFrame, batch_size: int, shape: Sequence[int] | None = None, dtype: str = "float32") -> DataFrame:
    """(batch, items, shape, data): the windows of a signal, whose first axis numbers them, as one array per batch in row-major order.

    A batch is made in one task. ``shape`` is that of a window (found from the data if it isn't given, one row); places without a value are NaN. ``items`` are the
    windows' numbers, in order; windows without any value are left out.
    """
    item, axes = x.axes[0], list(x.axes[1:])
    if shape is None:
        sizes = x.df.agg(*[(F.max(a) + 1).alias(a) for a in axes]).first() if axes else ()
        shape = [int(n or 0) for n in sizes]
    shape = [int(n) for n in shape]

    def made(t: pa.Table) -> pa.Table:
        items, place = np.unique(t[item].to_numpy(), return_inverse=True)
        out = np.full((len(items), *shape), np.nan, dtype)
        out[(place, *[t[a].to_numpy() for a in axes])] = t["value"].to_numpy(zero_copy_only=False)
        return pa.table({"batch": pa.array([int(items[0]) // batch_size], pa.int64()), "items": pa.array([items.tolist()], pa.list_(pa.int64())), "shape": pa.array([list(out.shape)], pa.list_(pa.int32())), "data": pa.array([out.ravel()], pa.list_(pa.float32() if dtype == "float32" else pa.float64()))})

    kind = "float" if dtype == "float32" else "double"
    return x.df.groupBy(F.floor(F.col(item) / batch_size).alias("__batch")).applyInArrow(made, f"batch long, items array<long>, shape array<int>, data array<{kind}>")


def batch_arrays(inputs: dict[str, SignalFrame], targets: dict[str, SignalFrame], batch_size: int, shapes: dict[str, Sequence[int]] | None = None) -> Iterator[tuple]:
    """(inputs, targets) per batch as numpy arrays by modality, in the batches' order; the arrays themselves where there is one of each.

    Batches come to the caller one partition at a time, and the next is computed meanwhile. A batch holds the windows that all modalities have.
    """
    named = [*[("x", k, v) for k, v in inputs.items()], *[("y", k, v) for k, v in targets.items()]]
    joined = None
    for kind, k, v in named:
        one = dense_batches(v, batch_size, (shapes or {}).get(k)).select("batch", F.struct("items", "shape", "data").alias(f"{kind}:{k}"))
        joined = one if joined is None else joined.join(one, "batch")
    for row in joined.orderBy("batch").toLocalIterator(prefetchPartitions=True):
        cells = [row[f"{kind}:{k}"] for kind, k, _ in named]
        common = reduce(np.intersect1d, [np.array(c["items"]) for c in cells])
        if not len(common):
            continue
        arrays = [np.array(c["data"], np.float32).reshape(c["shape"])[np.searchsorted(c["items"], common)] for c in cells]
        x, y = ({k: a for (kind, k, _), a in zip(named, arrays, strict=True) if kind == side} for side in "xy")
        yield (next(iter(x.values())), next(iter(y.values()))) if len(x) == len(y) == 1 else (x, y)


def supervised_pairs(recordings: dict[str, DataFrame], starts: DataFrame, size: int, inputs: Sequence[str], targets: Sequence[str], transform: Callable[[SignalFrame], SignalFrame] | None = None, target_transform: Callable[[SignalFrame], SignalFrame] | None = None, fs: float | None = None) -> tuple[dict[str, SignalFrame], dict[str, SignalFrame]]:
    """The windows (window_id, task, start) of every input and target modality (task, axes, t, value), as signals with a first axis ``batch``: the window.

    A modality without the window's task, or too short for it, has no rows for it. Transforms see all windows at once.
    """

    def windows(name: str, f: Callable[[SignalFrame], SignalFrame] | None) -> SignalFrame:
        df = recordings[name]
        axes = [c for c in df.columns if c not in ("task", "value", "split", "seam", "modality", "t")]
        got = fetch_windows(df.select("task", *axes, "t", "value"), starts, size).withColumnRenamed("window_id", "batch")
        x = signal(got.select("batch", *axes, "t", "value"), ("batch", *axes, "t"), fs)
        return f(x) if f else x

    if unknown := {*inputs, *targets} - set(recordings):
        raise ValueError(f"no modality {sorted(unknown)}")
    return {n: windows(n, transform) for n in inputs}, {n: windows(n, target_transform) for n in targets}


def collate(x: dict[str, SignalFrame]) -> SignalFrame | dict[str, SignalFrame]:
    """The one signal, or the signals by name where there are several."""
    return next(iter(x.values())) if len(x) == 1 else x


@dataclass
class DataModule:
    """The three splits of a store as pairs of inputs and targets: train by random windows (or a stride), val and test by a stride."""

    spark: SparkSession
    path: str
    inputs: Sequence[str] = ("emg",)
    targets: Sequence[str] = ("kinematics",)
    window_size: int = 200
    window_stride: int | None = None
    n_windows_per_epoch: int | None = None
    train_transform: Callable | None = None
    val_transform: Callable | None = None
    test_transform: Callable | None = None
    target_transform: Callable | None = None
    seed: int = 0

    def __post_init__(self):
        if self.n_windows_per_epoch is None and self.window_stride is None:
            raise ValueError("give n_windows_per_epoch or window_stride")

    def pairs(self, split: str, epoch: int = 0) -> tuple:
        """(inputs, targets) of a split; an epoch draws its own training windows."""
        return tuple(map(collate, self._pairs(split, epoch)))

    def batches(self, split: str, batch_size: int, epoch: int = 0, shapes: dict[str, Sequence[int]] | None = None) -> Iterator[tuple]:
        """(inputs, targets) of a split as arrays, batch by batch (``batch_arrays``)."""
        return batch_arrays(*self._pairs(split, epoch), batch_size, shapes)

    def _pairs(self, split: str, epoch: int) -> tuple[dict[str, SignalFrame], dict[str, SignalFrame]]:
        rows = {n: read_split(self.spark, self.path, n, split) for n in (*self.inputs, *self.targets)}
        first = rows[self.inputs[0]]
        if split == "train" and self.n_windows_per_epoch:
            starts = random_starts(first, self.window_size, self.n_windows_per_epoch, self.seed + epoch, strict=True)
        else:
            starts = window_starts(first, self.window_size, self.window_stride or self.window_size, strict=True)
        transform = {"train": self.train_transform, "val": self.val_transform, "test": self.test_transform or self.val_transform}[split]
        return supervised_pairs(rows, starts, self.window_size, self.inputs, self.targets, transform, self.target_transform, read_meta(self.spark, self.path)["sampling_frequency"])


def sample_shapes(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row with the length of each axis but time."""
    return df.agg(*[(F.max(a) + 1).alias(a) for a in axes if a != "t"])


def storage_sizes(df: DataFrame, by: Sequence[str] = ("split",), item_bytes: int = 4) -> DataFrame:
    """Values, and mebibytes of them, per split (and modality)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), (F.count("*") * item_bytes / 1048576.0).alias("mb"))


def split_summary(df: DataFrame) -> DataFrame:
    """Per split: recordings, samples of the longest one, and values."""
    return df.groupBy("split").agg(F.count_distinct("task").alias("tasks"), (F.max("t") + 1).alias("longest"), F.count("*").alias("n"))


def label_groups(df: DataFrame, recording: str = "task", text: bool = False) -> DataFrame:
    """(recording, label, one_hot): recordings numbered by name, one row each; ``one_hot`` is an array of 0 and 1, with ``text`` a string of these digits.

    One task numbers the names; the labels, n digits each, are made after the numbers are dealt out again, and aren't moved.
    """
    names = df.select(recording).distinct()
    both = names.withColumns({"label": F.row_number().over(Window.orderBy(recording)) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    # With the number given, the few bytes of the numbers aren't put into fewer tasks: what is made of them is far larger.
    dealt = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label")
    before, behind = F.col("label").cast("int"), (F.col("n") - 1 - F.col("label")).cast("int")
    if text:
        one_hot = F.concat(F.repeat(F.lit("0"), before), F.lit("1"), F.repeat(F.lit("0"), behind))
    else:
        one_hot = F.concat(F.array_repeat(F.lit(0), before), F.array(F.lit(1)), F.array_repeat(F.lit(0), behind))
    return dealt.select(recording, "label", one_hot.alias("one_hot"))


@dataclass
class GroupStore:
    """Named groups of arrays under a folder, as Parquet: an array is a table whose first column, ``sample``, numbers its rows."""

    spark: SparkSession
    path: str

    def _fs(self, *parts: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path("/".join([self.path, *parts]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, *parts: str) -> list[str]:
        fs, at = self._fs(*parts)
        return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []

    def groups(self) -> list[str]:
        return self._names()

    def arrays(self, group: str) -> list[str]:
        return self._names(group)

    def has_group(self, group: str) -> bool:
        return group in self.groups()

    def has_array(self, group: str, array: str) -> bool:
        return array in self.arrays(group)

    def add(self, group: str, array: str, rows: DataFrame) -> None:
        """Create the array, or append to it: its samples are numbered on from those stored. A table without rows is not stored."""
        if rows.isEmpty():
            return
        first = (self.read(group, array).agg(F.max("sample")).first()[0] or 0) + 1 if self.has_array(group, array) else 0
        rows.withColumn("sample", F.col("sample") + first).write.mode("append").parquet(f"{self.path}/{group}/{array}")

    def read(self, group: str, array: str = "data") -> DataFrame:
        if not self.has_array(group, array):
            raise KeyError(f"no array {array!r} in group {group!r}")
        return self.spark.read.parquet(f"{self.path}/{group}/{array}")

    def augment(self, array: str, transforms: dict[str, Callable[[DataFrame, int], DataFrame]], times: int = 1) -> None:
        """Append ``times`` copies of the array's samples to every group that has it: each group's by its transform of (rows, number of the copy), others' as they are."""
        groups = [g for g in self.groups() if self.has_array(g, array)]
        if unknown := set(transforms) - set(groups):
            raise KeyError(f"no array {array!r} in the groups {sorted(unknown)}")
        for g in groups:
            rows = self.read(g, array)
            n = (rows.agg(F.max("sample")).first()[0] or 0) + 1
            copies = [transforms[g](rows, k) if g in transforms else rows for k in range(1, times + 1)]
            made = reduce(DataFrame.unionByName, [c.withColumn("sample", F.col("sample") + (k - 1) * n) for k, c in enumerate(copies, 1)])
            self.add(g, array, made)

    def sample(self, i: int, inputs: str = "emg", array: str = "data") -> tuple[DataFrame, DataFrame]:
        """The input and the target of one sample; the target is the first group that holds neither inputs nor labels. Other samples' row groups aren't read."""
        if not self.has_group(inputs):
            raise ValueError(f"the store has no group {inputs!r}")
        targets = [g for g in self.groups() if g not in (inputs, "label", "class", "one_hot_class")]
        if not targets:
            raise ValueError("the store has no target group")
        return tuple(self.read(g, array).where(F.col("sample") == i) for g in (inputs, targets[0]))


def batches(windows: DataFrame, batch_size: int) -> DataFrame:
    return windows.withColumns({"batch": F.floor(F.col("window_id") / batch_size), "item": F.col("window_id") % batch_size})


def log_predictions(pairs: DataFrame, path: str, run_id: str, split: str) -> None:
    """Append (axes, pred, truth) of a run."""
    pairs.withColumns({"run_id": F.lit(run_id), "split": F.lit(split)}).write.mode("append").partitionBy("run_id", "split").parquet(path)


def load_predictions(spark: SparkSession, path: str, run_id: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("run_id") == run_id) & (F.col("split") == split))


def list_runs(runs: DataFrame, status: str | None = None) -> DataFrame:
    """The runs (run_id, run_name, status, start_time, tags, metrics), the last one first."""
    return (runs if status is None else runs.where(F.col("status") == status)).orderBy(F.col("start_time").desc(), "run_id")


def log_run(spark: SparkSession, path: str, run_id: str, run_name: str, status: str, start_time, tags: dict[str, str] | None = None, metrics: dict[str, float] | None = None) -> None:
    """Append a run to a table of runs; its configuration goes into the tags."""
    spark.createDataFrame([(run_id, run_name, status, start_time, tags or {}, metrics or {})], "run_id string, run_name string, status string, start_time timestamp, tags map<string,string>, metrics map<string,double>").write.mode("append").parquet(path)


def _flat(config: dict, before: str = "") -> dict:
    return {k: v for name, of in config.items() for k, v in (_flat(of, f"{before}{name}.") if isinstance(of, dict) else {f"{before}{name}": of}).items()}


def log_config(spark: SparkSession, path: str, run_id: str, config: dict) -> None:
    """Append a run's configuration as (run_id, key, value): nested names are joined by dots, values are JSON."""
    spark.createDataFrame([(run_id, k, json.dumps(v)) for k, v in _flat(config).items()], "run_id string, key string, value string").write.mode("append").partitionBy("run_id").parquet(path)


def read_config(spark: SparkSession, path: str, run_id: str) -> dict:
    return {r.key: json.loads(r.value) for r in spark.read.parquet(path).where(F.col("run_id") == run_id).collect()}


def log_sources(spark: SparkSession, path: str, run_id: str, files: dict[str, str]) -> None:
    """Append the texts of a run's source files as (run_id, name, text)."""
    spark.createDataFrame([(run_id, n, t) for n, t in files.items()], "run_id string, name string, text string").write.mode("append").parquet(path)


def latest_run(runs: DataFrame) -> DataFrame:
    """The finished run that started last."""
    return runs.where("status = 'FINISHED'").orderBy(F.col("start_time").desc(), "run_id").limit(1)
