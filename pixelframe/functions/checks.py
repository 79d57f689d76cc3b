"""Argument checks, made when a plan is built."""

from __future__ import annotations

import math
from collections.abc import Sequence
from numbers import Real

PAD_MODES = ("reflect", "constant", "replicate")


def checked_kernel(kernel: Sequence[Sequence[float]], name: str = "kernel") -> list[list[float]]:
    """A non-empty numeric matrix with odd sides."""
    if isinstance(kernel, (str, bytes)) or not hasattr(kernel, "__len__"):
        raise TypeError(f"{name} must be a matrix")
    rows = [list(r) if hasattr(r, "__len__") and not isinstance(r, str) else None for r in kernel]
    if not rows or None in rows or not rows[0] or len({len(r) for r in rows}) != 1:
        raise ValueError(f"{name} must be a non-empty matrix")
    if any(isinstance(v, bool) or not isinstance(v, Real) for r in rows for v in r):
        raise TypeError(f"{name} must hold numbers")
    if len(rows) % 2 == 0 or len(rows[0]) % 2 == 0:
        raise ValueError(f"{name} must have odd sides")
    return [[float(v) for v in r] for r in rows]


def odd_size(size: int, name: str, least: int = 1) -> int:
    if isinstance(size, bool) or not isinstance(size, int):
        raise TypeError(f"{name} must be an integer")
    if size < least or size % 2 == 0:
        raise ValueError(f"{name} must be odd and at least {least}")
    return size


def whole(value: int, name: str, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an integer")
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value


def one_of(value: str, names: Sequence[str], name: str) -> str:
    if value not in names:
        raise ValueError(f"{name} must be one of {', '.join(names)}")
    return value


def positive(value: float, name: str) -> float:
    if not isinstance(value, Real) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be positive")
    return float(value)
