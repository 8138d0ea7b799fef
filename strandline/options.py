"""Defaults of the timeline operators, with named profiles."""

from __future__ import annotations

import sys
from dataclasses import dataclass, fields, replace
from fractions import Fraction

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package


@dataclass(frozen=True)
class Options:
    """All tunables; times are in the timeline's own unit (seconds)."""

    sample_step: float = 1.0
    min_sheet: float = 60.0
    max_sheet: float = 600.0
    target_keyframes: int = 16
    max_keyframes: int = 16
    min_segment: float = 4.0
    max_segment: float = 18.0
    visual_sensitivity: float = 1.35
    micro_sensitivity: float = 1.6
    micro_lookahead: float = 2.0
    min_micro_gap: float = 2.0
    max_micro: int = 6
    regional_weight: float = 0.8
    island_threshold: float = 60.0
    island_weight: float = 1.8
    island_window: int = 2
    max_gap: float = 45.0
    max_gap_picks: int = 4
    boundary_gap: float = 24.0
    max_boundary_picks: int = 2
    action_gap: float = 20.0
    action_min_activity: float = 0.45
    max_action_picks: int = 4
    color_shift: float = 72.0
    similar_window: float = 6.0
    similar_distance: float = 0.06
    duplicate_window: float = 5.0
    duplicate_distance: float = 0.11
    motion_weight: float = 260.0
    low_luma: float = 0.035
    high_luma: float = 0.97
    anchor_distance: float = 6.0
    anchor_chars: int = 24
    anchor_words: int = 6
    audio_gain: float = 2.2
    audio_step: float = 0.25
    audio_weight: float = 130.0
    audio_threshold: float = 0.55
    audio_window: float = 0.5
    audio_context: float = 2.0
    audio_min_level: float = 0.12
    max_sheets: int = 0
    pins: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if self.sample_step <= 0:
            raise ValueError("sample_step must be positive")
        if self.min_segment < 0 or self.max_sheet <= 0:
            raise ValueError("durations must be positive")


@dataclass(frozen=True)
class Recognition:
    """How frames are taken for the recognition of burned-in text."""

    fps: float = 2.0
    crop: float = 0.34
    width: int = 960

    def __post_init__(self) -> None:
        if self.fps <= 0:
            raise ValueError("fps must be positive")
        if not 0.15 <= self.crop <= 0.65:
            raise ValueError("crop must lie between 0.15 and 0.65")
        if self.width < 320:
            raise ValueError("width must be 320 at least")


def usable_range(start: float, end: float | None, duration: float) -> tuple[float, float]:
    """A range cut to the film; an empty one is an error."""
    a, b = max(0.0, start), min(duration, duration if end is None else end)
    if a >= b:
        raise ValueError(f"the range from {a} to {b} is empty")
    return a, b


def frame_rate(step: float) -> str:
    """Frames a second of a sample step, as a fraction with a denominator of 1000 at most."""
    f = Fraction(1 / step).limit_denominator(1000)
    return f"{f.numerator}/{f.denominator}"


def decimal_rate(fps: float) -> str:
    """A rate with 6 decimals at most, and no zeros at its end."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    return f"{fps:.6f}".rstrip("0").rstrip(".")


PROFILES = {
    "batch": Options(),
    "reader": Options(max_sheet=420.0),
    "balanced": Options(min_sheet=20.0, max_sheet=300.0, min_segment=2.0, max_segment=10.0, max_gap=20.0, boundary_gap=12.0, action_gap=10.0),
    "dense": Options(min_sheet=10.0, max_sheet=300.0, min_segment=1.0, max_segment=5.0, max_gap=8.0, boundary_gap=6.0, action_gap=5.0, min_micro_gap=1.0, max_micro=12),
}


def profile(name: str, **changes) -> Options:
    """A named profile with some fields replaced."""
    return replace(PROFILES[name], **changes)


def arguments(options: Options) -> list[str]:
    """The options that differ from the defaults, as arguments of a command line; parsed() reads them again."""
    out = []
    for f in fields(Options):
        value = getattr(options, f.name)
        if value != f.default:
            out += [f"--{f.name.replace('_', '-')}", ",".join(map(str, value)) if isinstance(value, tuple) else str(value)]
    return out


def parsed(args: list[str]) -> Options:
    """Options of a command line; an unknown name is an error."""
    kinds = {f.name: type(f.default) for f in fields(Options)}
    got = {}
    for name, value in zip(args[::2], args[1::2], strict=True):
        key = name.removeprefix("--").replace("-", "_")
        if key not in kinds or not name.startswith("--"):
            raise ValueError(f"not an option: {name}")
        got[key] = tuple(float(x) for x in value.split(",") if x) if kinds[key] is tuple else kinds[key](value)
    return Options(**got)
