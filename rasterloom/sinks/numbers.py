"""Numbers as text."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal


def fixed(value: float, digits: int) -> str:
    """``digits`` decimals, binary ties away from zero, trailing zeros and a bare sign dropped; 0 if not finite."""
    if not math.isfinite(value):
        return "0"
    text = format(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP), "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def short(value: float, digits: int) -> str:
    """As ``fixed``, without the zero before the point."""
    text = fixed(value, digits)
    return text.replace("0.", ".", 1) if text.startswith(("0.", "-0.")) else text


def half_up(value: float, digits: int) -> float:
    scale = 10**digits
    return math.floor(value * scale + 0.5) / scale
