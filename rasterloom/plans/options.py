"""Tracing options, their limits, and the presets."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace

#: Limits of the integer options.
INTEGERS = {"max_colors": (1, 256), "detail": (0, 100), "smoothing": (0, 100), "denoise": (0, 100), "alpha_threshold": (0, 255), "precision": (0, 6)}
BACKGROUNDS, STROKE_MODES, FORMATS = ("auto", "keep", "remove"), ("off", "auto", "force"), ("svg", "pdf", "eps", "dxf", "png", "jpeg")


@dataclass(frozen=True)
class Options:
    """Settings of one trace; the defaults are the engine's own, which no preset has."""

    max_colors: int = 8
    detail: int = 55
    smoothing: int = 60
    denoise: int = 45
    alpha_threshold: int = 128
    background: str = "auto"
    color_merge_threshold: float = 6.0
    max_dimension: float = 1400.0
    precision: int = 2
    seed: int = 24301
    stroke_mode: str = "off"
    min_stroke_elongation: float = 5.0
    min_area: float | None = None
    palette: tuple[str, ...] | None = None

    def clamped(self) -> Options:
        """Integers rounded into their limits (a number that isn't finite becomes the lower one), enumerations checked."""
        change: dict = {k: clamp_int(getattr(self, k), lo, hi) for k, (lo, hi) in INTEGERS.items()}
        change["color_merge_threshold"] = max(0.0, float(self.color_merge_threshold))
        change["min_stroke_elongation"] = max(1.0, float(self.min_stroke_elongation))
        if self.background not in BACKGROUNDS or self.stroke_mode not in STROKE_MODES:
            raise ValueError(f"unknown background or stroke mode: {self.background!r}, {self.stroke_mode!r}")
        return replace(self, **change)

    def with_(self, **overrides) -> Options:
        return replace(self, **{k: v for k, v in overrides.items() if v is not None})


NAMES = tuple(f.name for f in fields(Options))


#: Ranges that a user's settings have to be in; the second part of a pair is None where there is no most.
RANGES = {
    "max_colors": (1, 256), "detail": (0, 100), "smoothing": (0, 100), "denoise": (0, 100), "color_merge_threshold": (0, 50),
    "max_dimension": (64, 8192), "precision": (0, 6), "min_area": (1, None), "min_stroke_elongation": (1, 50),
}
_WHOLE = ("max_colors", "max_dimension", "precision")


def check(overrides: dict) -> None:
    """Refuses unknown settings, numbers out of range or not whole where they have to be, and unknown choices, with the reason."""
    for k, v in overrides.items():
        if k not in NAMES:
            raise ValueError(f"unknown setting {k!r}")
        if v is None:
            continue
        if k in RANGES:
            low, high = RANGES[k]
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or v < low or high is not None and v > high or k in _WHOLE and v != int(v):
                raise ValueError(f"{k} has to be {'a whole number' if k in _WHOLE else 'a number'} from {low}" + (f" to {high}" if high is not None else "") + f", not {v!r}")
        for name, choices in (("background", BACKGROUNDS), ("stroke_mode", STROKE_MODES)):
            if k == name and v not in choices:
                raise ValueError(f"{k} has to be one of {', '.join(choices)}, not {v!r}")


def clamp_int(value: float, low: int, high: int) -> int:
    if value is None or not math.isfinite(value):
        return low
    return max(low, min(high, math.floor(value + 0.5)))


def least_area(options: Options, width: int, height: int) -> float:
    """Source pixels below which a region is a speck."""
    if options.min_area is not None:
        return options.min_area
    return max(2, math.floor(width * height * 0.00002 * (0.4 + options.denoise / 100 * 1.6) + 0.5))


def noise_gate(denoise: float) -> float:
    """Noise above which the median filter runs, where ``denoise`` is over 10."""
    return 0.04 + 0.16 * (1 - denoise / 100)


#: Id, label and settings of each preset.
PRESETS: dict[str, tuple[str, dict]] = {
    "logo": ("Logo & wordmark", dict(max_colors=6, detail=62, smoothing=45, denoise=35, color_merge_threshold=7.0, background="auto", precision=2)),
    "sticker": ("Sticker & decal", dict(max_colors=8, detail=52, smoothing=62, denoise=60, color_merge_threshold=8.0, background="auto", precision=2)),
    "apparel": ("Apparel graphic", dict(max_colors=7, detail=50, smoothing=60, denoise=55, color_merge_threshold=9.0, background="auto", precision=2)),
    "lineart": ("Line art", dict(max_colors=3, detail=66, smoothing=55, denoise=30, color_merge_threshold=12.0, background="auto", precision=2, stroke_mode="auto")),
    "centerline": ("Centreline / plotter", dict(max_colors=3, detail=66, smoothing=60, denoise=30, color_merge_threshold=12.0, background="auto", precision=2, stroke_mode="force")),
    "ai-art": ("AI illustration", dict(max_colors=12, detail=55, smoothing=65, denoise=50, color_merge_threshold=6.0, background="auto", precision=2)),
    "pixel-art": ("Pixel art", dict(max_colors=16, detail=100, smoothing=0, denoise=0, color_merge_threshold=0.0, background="auto", precision=0, max_dimension=4096.0)),
    "poster": ("Poster & wall art", dict(max_colors=10, detail=58, smoothing=70, denoise=45, color_merge_threshold=5.0, background="keep", precision=2)),
}
DEFAULT_PRESET = "logo"


def resolve(preset: str, overrides: dict | None = None, recommended: dict | None = None) -> Options:
    """The preset's settings, over them the recommended ones, over them what is given explicitly."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; there are {', '.join(PRESETS)}")
    return Options(**PRESETS[preset][1]).with_(**(recommended or {})).with_(**(overrides or {}))


def as_dict(options: Options) -> dict:
    return asdict(options)
