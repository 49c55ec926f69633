"""Durations as texts like 1h30m, 340s or 1.5ms, and as whole nanoseconds."""

from __future__ import annotations

import re
from decimal import Decimal

_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def nanoseconds(value: str | int | float | None) -> int:
    """Nanoseconds of a duration text or of a number that counts them; null is 0."""
    if value is None:
        return 0
    if isinstance(value, (int, float)):
        return int(value)
    text = value.strip()
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text.removeprefix("+"))
    if body == "0":
        return 0
    at, total = 0, Decimal(0)
    for part in _PART.finditer(body):
        if part.start() != at:
            break
        total += Decimal(part[1]) * _UNITS[part[2]]
        at = part.end()
    if not body or at != len(body):
        raise ValueError(f"not a duration: {value!r}")
    return sign * int(total)


def seconds(value: str | int | float | None) -> float:
    return nanoseconds(value) / 1e9
