"""Ready pipelines for hand kinematics from electrode grids: two representations in, the window's mean pose out."""

from __future__ import annotations

from dataclasses import dataclass

from ..frame import Compose, Identity, Transform
from ..operators import augment, filters, normalize, shape


@dataclass(frozen=True)
class Preset:
    """The published set-up's numbers."""

    fs: float = 2048.0
    window_size: int = 192
    cutoff: float = 20.0
    order: int = 4
    noise: float = 0.1
    warp: tuple[float, int] = (0.35, 6)


def kinematics() -> Compose:
    """(joint, xyz, t) of 21 joints as (channel, t) without the first joint."""
    return Compose([shape.Flatten(0, 1, [3], "channel"), shape.Index(slice(3, None), "channel")])


def evaluation(preset: Preset = Preset()) -> Compose:
    """The signal and its low-passed form, along a new first axis."""
    return Compose([shape.Stack({"raw": Identity(), "filtered": filters.lowpass(preset.cutoff, preset.fs, preset.order)})])


def training(preset: Preset = Preset(), augmentation: str = "noise", seed: int = 0) -> Compose:
    """``evaluation``, then noise, a warp of the magnitude, or none of them."""
    more: dict[str, list[Transform]] = {
        "noise": [augment.GaussianNoise(preset.noise, seed)],
        "warp": [augment.Randomly(augment.draw_magnitude_warp(*preset.warp), 1.0, seed)],
        "none": [],
    }
    if augmentation not in more:
        raise ValueError(f"no augmentation {augmentation!r}")
    return Compose([*evaluation(preset).steps, *more[augmentation]])


def target() -> normalize.Mean:
    return normalize.Mean("t")
