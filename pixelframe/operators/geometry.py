"""Geometric operators: for each place of the result, where in the source it comes from.

The source places are arithmetic on the place and the same for all images of
one shape, so a gather is an array access in a whole stack of images; no pixel
is joined with another.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..functions.checks import one_of, whole
from ..functions.stacks import on_stacks, restored

INTERPOLATIONS = ("nearest", "bilinear")


def _nearest(x: np.ndarray, r: np.ndarray, c: np.ndarray, fill: float) -> np.ndarray:
    h, w = x.shape[1:3]
    y, z = np.rint(r).astype(int), np.rint(c).astype(int)
    inside = (y >= 0) & (y < h) & (z >= 0) & (z < w)
    return np.where(inside[None, :, :, None], x[:, np.clip(y, 0, h - 1), np.clip(z, 0, w - 1)], fill)


def _bilinear(x: np.ndarray, r: np.ndarray, c: np.ndarray, fill: float, u8: bool) -> np.ndarray:
    """Four neighbours by their distance. Places from 0 up to, not including, the side count as inside."""
    h, w = x.shape[1:3]
    inside = (r >= 0) & (r < h) & (c >= 0) & (c < w)
    y, z = np.clip(np.floor(r).astype(int), 0, h - 1), np.clip(np.floor(c).astype(int), 0, w - 1)
    down, right = (r - np.floor(r))[None, :, :, None], (c - np.floor(c))[None, :, :, None]
    below, beside = np.minimum(y + 1, h - 1), np.minimum(z + 1, w - 1)
    upper = x[:, y, z] * (1 - right) + x[:, y, beside] * right
    lower = x[:, below, z] * (1 - right) + x[:, below, beside] * right
    return np.where(inside[None, :, :, None], restored(upper * (1 - down) + lower * down, u8), fill)


def _gather(images: DataFrame, shape: Callable[[int, int], tuple[int, int]], source: Callable, interpolation: str, fill: float) -> DataFrame:
    """source(r, c, height, width): where the values of rows r and columns c of the result come from."""
    one_of(interpolation, INTERPOLATIONS, "interpolation")

    def run(u8: bool, x: np.ndarray) -> dict[str, np.ndarray]:
        h, w = x.shape[1:3]
        r, c = np.meshgrid(*(np.arange(n, dtype=float) for n in shape(h, w)), indexing="ij")
        y, z = source(r, c, h, w)
        return {"data": _nearest(x, y, z, float(fill)) if interpolation == "nearest" else _bilinear(x, y, z, float(fill), u8)}

    return on_stacks(images, run)


def resize(images: DataFrame, out_height: int, out_width: int, interpolation: str = "bilinear") -> DataFrame:
    whole(out_height, "out_height", 1), whole(out_width, "out_width", 1)
    source = lambda r, c, h, w: ((r + 0.5) * (h / out_height) - 0.5, (c + 0.5) * (w / out_width) - 0.5)
    return _gather(images, lambda h, w: (out_height, out_width), source, interpolation, 0)


def rotate(images: DataFrame, angle: float, interpolation: str = "bilinear", fill: float = 0) -> DataFrame:
    """Counter-clockwise about the centre, on the same canvas."""
    theta = math.radians(-angle)
    cos, sin = math.cos(theta), math.sin(theta)

    def source(r: np.ndarray, c: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        cy, cx = (h - 1) / 2.0, (w - 1) / 2.0
        return cos * (r - cy) - sin * (c - cx) + cy, sin * (r - cy) + cos * (c - cx) + cx

    return _gather(images, lambda h, w: (h, w), source, interpolation, fill)


def translate(images: DataFrame, tx: float, ty: float, interpolation: str = "bilinear", fill: float = 0) -> DataFrame:
    return _gather(images, lambda h, w: (h, w), lambda r, c, h, w: (r - ty, c - tx), interpolation, fill)
