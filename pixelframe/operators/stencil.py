"""Neighbourhood operators on image rows.

Images of one shape are padded together as a stack; a neighbour is then a shift
of the whole stack, so a stencil is as many array sums as it has taps, without
a join or shuffle.  Kernels of rank one run as a row pass and a column pass.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import PAD_MODES, checked_kernel, odd_size, one_of, positive, whole
from ..functions.stacks import on_stacks, padded, restored

# fixed values: the Sobel kernels, and the neighbours of a local binary pattern, clockwise from the top left
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
LBP_NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


def pad_image(images: DataFrame, pad_h: int, pad_w: int, mode: str = "reflect", constant_value: float = 0) -> DataFrame:
    whole(pad_h, "pad_h", 0), whole(pad_w, "pad_w", 0), one_of(mode, PAD_MODES, "mode")
    if not pad_h and not pad_w:
        return images
    return on_stacks(images, lambda u8, x: {"data": padded(x, pad_h, pad_w, mode, float(constant_value))})


def weighted(x: np.ndarray, kernel: list[list[float]], mode: str) -> np.ndarray:
    """True convolution of a stack (the kernel turned by 180 degrees), channel by channel."""
    kh, kw = len(kernel), len(kernel[0])
    grown, out = padded(x, kh // 2, kw // 2, mode), np.zeros(x.shape)
    for i, row in enumerate(kernel):
        for j, k in enumerate(row):
            if k:
                y, z = kh - 1 - i, kw - 1 - j
                out += grown[:, y : y + x.shape[1], z : z + x.shape[2]] * float(k)
    return out


def two_passes(x: np.ndarray, column: list[float], row: list[float], mode: str) -> np.ndarray:
    return weighted(weighted(x, [row], mode), [[v] for v in column], mode)


def windows(x: np.ndarray, size: int, mode: str) -> np.ndarray:
    """For each value its size x size neighbours, on a last axis."""
    grown = padded(x, size // 2, size // 2, mode)
    return np.stack([grown[:, i : i + x.shape[1], j : j + x.shape[2]] for i in range(size) for j in range(size)], axis=-1)


def convolve2d(images: DataFrame, kernel, pad_mode: str = "reflect") -> DataFrame:
    """Convolution to float values of the same size; channel by channel."""
    one_of(pad_mode, PAD_MODES, "pad_mode")
    taps = checked_kernel(kernel)
    return on_stacks(images, lambda u8, x: {"data": weighted(x, taps, pad_mode)}, dtype="f64")


def spatial_filter(images: DataFrame, kernel, pad_mode: str = "reflect") -> DataFrame:
    """Convolution in the image's own type."""
    one_of(pad_mode, PAD_MODES, "pad_mode")
    taps = checked_kernel(kernel)
    return on_stacks(images, lambda u8, x: {"data": restored(weighted(x, taps, pad_mode), u8)})


def mean_filter(images: DataFrame, kernel_size: int = 3, pad_mode: str = "reflect") -> DataFrame:
    """Box filter: sums in two passes, divided once at the end so that whole numbers stay exact."""
    k = odd_size(kernel_size, "kernel_size")
    one_of(pad_mode, PAD_MODES, "pad_mode")
    return on_stacks(images, lambda u8, x: {"data": restored(two_passes(x, [1.0] * k, [1.0] * k, pad_mode) / (k * k), u8)})


def gaussian_weights(size: int, sigma: float) -> list[float]:
    """One axis of the normalised kernel."""
    half = odd_size(size, "size") // 2
    sigma = positive(sigma, "sigma")
    w = [math.exp(-x * x / (2 * sigma * sigma)) for x in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def gaussian_kernel(size: int, sigma: float) -> list[list[float]]:
    w = gaussian_weights(size, sigma)
    return [[a * b for b in w] for a in w]


def blurred(x: np.ndarray, size: int, sigma: float, mode: str, u8: bool) -> np.ndarray:
    w = gaussian_weights(size, sigma)
    return restored(two_passes(x, w, w, mode), u8)


def gaussian_filter(images: DataFrame, kernel_size: int = 5, sigma: float = 1.0, pad_mode: str = "reflect") -> DataFrame:
    gaussian_weights(kernel_size, sigma), one_of(pad_mode, PAD_MODES, "pad_mode")
    return on_stacks(images, lambda u8, x: {"data": blurred(x, kernel_size, sigma, pad_mode, u8)})


def median_filter(images: DataFrame, kernel_size: int = 3, pad_mode: str = "reflect") -> DataFrame:
    k = odd_size(kernel_size, "kernel_size")
    one_of(pad_mode, PAD_MODES, "pad_mode")
    return on_stacks(images, lambda u8, x: {"data": np.median(windows(x, k, pad_mode), axis=-1)})


def gradients(x: np.ndarray, mode: str) -> dict[str, np.ndarray]:
    """Sobel gradients with their magnitude, and angle in degrees from 0 up to 180."""
    gx, gy = weighted(x, SOBEL_X, mode) + 0.0, weighted(x, SOBEL_Y, mode) + 0.0
    angle = np.fmod(np.degrees(np.arctan2(gy, gx)), 180)
    return {"gx": gx, "gy": gy, "magnitude": np.sqrt(gx * gx + gy * gy), "angle": np.where(angle < 0, np.fmod(angle + 180, 180), angle)}


def sobel_gradients(images: DataFrame, pad_mode: str = "reflect") -> DataFrame:
    """Adds gx, gy, magnitude and angle (degrees in [0, 180))."""
    one_of(pad_mode, PAD_MODES, "pad_mode")
    return on_stacks(images, lambda u8, x: gradients(x, pad_mode), adds=("gx", "gy", "magnitude", "angle"))


def threshold_adaptive(images: DataFrame, block_size: int = 11, method: str = "mean", C: float = 2, max_val: float = 255) -> DataFrame:
    """max_val where a value is above its local mean less C."""
    k = odd_size(block_size, "block_size", 3)
    one_of(method, ("mean", "gaussian"), "method")
    if max_val <= 0:
        raise ValueError("max_val must be positive")
    w = [1.0] * k if method == "mean" else gaussian_weights(k, 0.3 * ((k - 1) / 2 - 1) + 0.8)
    part = float(k * k) if method == "mean" else 1.0
    return on_stacks(images, lambda u8, x: {"data": np.where(x > np.round(two_passes(x, w, w, "reflect") / part, 9) - C, float(max_val), 0.0)})


def patterns(x: np.ndarray) -> np.ndarray:
    grown, (h, w) = padded(x, 1, 1, "replicate"), x.shape[1:3]
    return sum(np.where(grown[:, 1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w] >= x, float(1 << i), 0.0) for i, (dr, dc) in enumerate(LBP_NEIGHBOURS))


def lbp_codes(images: DataFrame) -> DataFrame:
    """Local binary patterns: bit i is set where neighbour i is not below the centre; borders are replicated."""
    return on_stacks(images, lambda u8, x: {"data": patterns(x)})


def suppressed(magnitude: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Magnitudes that neither neighbour along the gradient exceeds; directions are the nearest multiples of 45 degrees."""
    grown, (h, w) = padded(magnitude, 1, 1, "replicate"), magnitude.shape[1:3]
    turn = np.mod(np.floor(angle / 45 + 0.5), 4)
    out = np.zeros(magnitude.shape)
    for k in range(4):
        dr, dc = (int(np.rint(f(np.radians(45 * k)))) for f in (np.sin, np.cos))
        ahead, behind = (grown[:, 1 + s * dr : 1 + s * dr + h, 1 + s * dc : 1 + s * dc + w] for s in (1, -1))
        stays = (turn == k) & (magnitude >= np.maximum(ahead, behind))
        out[stays] = magnitude[stays]
    return out


def thinned(images: DataFrame) -> DataFrame:
    """Non-maximum suppression of magnitude along the gradient; ties stay. Needs the columns of sobel_gradients."""
    return on_stacks(images, lambda u8, magnitude, angle: {"thin": suppressed(magnitude, angle)}, reads=("magnitude", "angle"), adds=("thin",))


def reached(strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Weak pixels that chains of weak pixels, by 8 neighbours, join to strong ones: whole stacks grow until they rest."""
    h, w = strong.shape[1:3]
    keep, left = strong.copy(), np.arange(len(strong))
    while len(left):
        rows = np.pad(keep[left], ((0, 0), (1, 1), (0, 0), (0, 0)))
        rows = rows[:, :h] | rows[:, 1 : h + 1] | rows[:, 2:]
        cols = np.pad(rows, ((0, 0), (0, 0), (1, 1), (0, 0)))
        grown = (cols[:, :, :w] | cols[:, :, 1 : w + 1] | cols[:, :, 2:]) & weak[left] | keep[left]
        moved = (grown != keep[left]).any(axis=(1, 2, 3))
        keep[left], left = grown, left[moved]
    return keep


def canny(images: DataFrame, low: float = 50, high: float = 150, kernel_size: int = 5, sigma: float = 1.4, pad_mode: str = "reflect") -> DataFrame:
    """Edges of gray images as 0 and 255."""
    if not 0 <= low < high:
        raise ValueError("thresholds must be 0 <= low < high")
    gaussian_weights(kernel_size, sigma), one_of(pad_mode, PAD_MODES, "pad_mode")

    def edges(u8: bool, x: np.ndarray) -> dict[str, np.ndarray]:
        found = gradients(blurred(x, kernel_size, sigma, pad_mode, u8), pad_mode)
        thin = suppressed(found["magnitude"], found["angle"])
        return {"data": np.where(reached(thin >= high, thin >= low), 255.0, 0.0)}

    return on_stacks(images, edges, dtype="u8")


def correlated(x: np.ndarray, weights: np.ndarray, bias: list[float], stride: int, pad: int) -> np.ndarray:
    n_out, n_in, kh, kw = weights.shape
    grown = padded(x, pad, pad, "constant")
    rows, cols = (grown.shape[1] - kh) // stride + 1, (grown.shape[2] - kw) // stride + 1
    out = np.zeros((len(x), max(rows, 0), max(cols, 0), n_out))
    for i in range(n_in):
        for y in range(kh):
            for z in range(kw):
                part = grown[:, y : y + stride * (rows - 1) + 1 : stride, z : z + stride * (cols - 1) + 1 : stride, i : i + 1]
                out += part * weights[:, i, y, z]
    return out + np.asarray(bias, float)


def cross_correlate(images: DataFrame, weights: np.ndarray, bias: list[float], stride: int = 1, pad: int = 0) -> DataFrame:
    """Convolution layer: weights (out, in, kh, kw) are not turned, borders are zero, channels are summed."""
    whole(stride, "stride", 1), whole(pad, "pad", 0)
    weights = np.asarray(weights, float)
    return on_stacks(images, lambda u8, x: {"data": correlated(x, weights, bias, stride, pad)}, dtype="f64")


def max_pool(images: DataFrame, size: int = 2, stride: int = 2) -> DataFrame:
    """Largest value of each full window."""
    whole(size, "size", 1), whole(stride, "stride", 1)

    def pooled(u8: bool, x: np.ndarray) -> dict[str, np.ndarray]:
        rows, cols = max((x.shape[1] - size) // stride + 1, 0), max((x.shape[2] - size) // stride + 1, 0)
        if not rows or not cols:
            return {"data": x[:, :rows, :cols]}
        parts = [x[:, y : y + stride * (rows - 1) + 1 : stride, z : z + stride * (cols - 1) + 1 : stride] for y in range(size) for z in range(size)]
        return {"data": np.max(parts, axis=0)}

    return on_stacks(images, pooled)


def relu(images: DataFrame) -> DataFrame:
    return images.withColumn("data", F.transform("data", lambda v: F.greatest(v, F.lit(0.0))))
