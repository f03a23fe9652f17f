"""Named representations of one recording: an immutable catalogue of signals."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from ..frame import SignalFrame, signal

#: Axes by kind; the second form has chunks first.
KINDS = {"emg": (("channel", "t"), ("batch", "channel", "t")), "kinematics": (("joint", "xyz", "t"), ("batch", "joint", "xyz", "t")), "virtual_hand": (("dof", "t"), ("batch", "dof", "t"))}


@dataclass(frozen=True, repr=False)
class Recording:
    """``Input`` and whatever was made from it, in order; a deleted representation keeps its name and axes only."""

    kind: str
    representations: dict[str, SignalFrame]
    deleted: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, kind: str, x: SignalFrame) -> Recording:
        if x.axes not in KINDS[kind]:
            raise ValueError(f"{kind} has axes {KINDS[kind][0]} or {KINDS[kind][1]}, not {x.axes}")
        if not x.fs or x.fs <= 0:
            raise ValueError("the sampling rate must be positive")
        return cls(kind, {"Input": x})

    def name(self, key: str) -> str:
        return list(self.representations)[-1] if key == "Last" else key

    def __getitem__(self, key: str) -> SignalFrame:
        key = self.name(key)
        if key in self.deleted:
            raise RuntimeError(f"{key} was deleted")
        return self.representations[key]

    def with_result(self, name: str, x: SignalFrame) -> Recording:
        if name in ("Input", "Last"):
            raise RuntimeError(f"{name} can't be set")
        return replace(self, representations={**self.representations, name: x}, deleted={k: v for k, v in self.deleted.items() if k != name})

    def without(self, key: str) -> Recording:
        key = self.name(key)
        if key == "Input":
            return self
        axes = self.representations[key].axes
        return replace(self, representations={k: v for k, v in self.representations.items() if k != key}, deleted={**self.deleted, key: axes})

    def is_chunked(self, key: str) -> bool:
        key = self.name(key)
        return "batch" in (self.deleted[key] if key in self.deleted else self[key].axes)

    def __repr__(self) -> str:
        shapes = {**{name: " x ".join(x.axes) for name, x in self.representations.items()}, **{name: f"{' x '.join(axes)} (deleted)" for name, axes in self.deleted.items()}}
        return "\n".join([f"{self.kind} at {self['Input'].fs} Hz", *[f"  {i}. {name}: {shape}" for i, (name, shape) in enumerate(shapes.items(), 1)]])

    def save(self, path: str) -> None:
        """Each representation that is there as Parquet under ``path``, and what they are beside them."""
        there = self.representations
        spark = next(iter(there.values())).df.sparkSession
        for k, x in enumerate(there.values()):
            x.df.write.mode("overwrite").parquet(f"{path}/representation={k}")
        meta = {"kind": self.kind, "axes": {n: x.axes for n, x in there.items()}, "fs": {n: x.fs for n, x in there.items()}, "deleted": self.deleted}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recording:
        meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
        there = {n: signal(spark.read.parquet(f"{path}/representation={k}"), axes, meta["fs"][n]) for k, (n, axes) in enumerate(meta["axes"].items())}
        deleted = {n: tuple(axes) for n, axes in meta["deleted"].items()}
        return cls(meta["kind"], there, deleted)
