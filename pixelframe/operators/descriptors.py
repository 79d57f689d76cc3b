"""Histogram of oriented gradients, and the assembled feature vector."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import whole
from ..functions.stacks import half_even_bytes, on_stacks
from .histogram import STATS
from .point import LUMA, crop
from .stencil import gradients as stack_gradients
from .stencil import patterns, sobel_gradients


def oriented(magnitude: np.ndarray, angle: np.ndarray, cell: int, n_bins: int, block: int, turn: float) -> np.ndarray:
    """Block-normalised direction histograms of a stack of gradients: (images, values)."""
    n, h, w, _ = magnitude.shape
    ny, nx = h // cell, w // cell
    if ny < block or nx < block:
        raise ValueError("the image is too small for a block")
    trim = (slice(None), slice(0, ny * cell), slice(0, nx * cell), 0)
    m, place = magnitude[trim], angle[trim] / (turn / n_bins)
    low, part = np.floor(place).astype(np.int64) % n_bins, place - np.floor(place)
    r, c = np.arange(ny * cell) // cell, np.arange(nx * cell) // cell
    at = ((np.arange(n)[:, None, None] * ny + r[None, :, None]) * nx + c[None, None, :]) * n_bins
    size = n * ny * nx * n_bins
    cells = np.bincount((at + low).ravel(), (m * (1 - part)).ravel(), size) + np.bincount((at + (low + 1) % n_bins).ravel(), (m * part).ravel(), size)
    windows = np.lib.stride_tricks.sliding_window_view(cells.reshape(n, ny, nx, n_bins), (block, block), axis=(1, 2))
    blocks = windows.transpose(0, 1, 2, 4, 5, 3).reshape(n, -1, block * block * n_bins)

    def scaled(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=2, keepdims=True))
        return x / np.where(norm > 0, norm, 1)

    return scaled(np.minimum(scaled(blocks), 0.2)).reshape(n, -1)


def hog_descriptor(images: DataFrame, cell_size: int = 8, n_bins: int = 9, block_size: int = 2, signed: bool = False, gradients: DataFrame | None = None) -> DataFrame:
    """(image_id, hog): block-normalised histograms of gradient directions of gray images.

    A pixel votes for the two bins around its angle.  With signed, bins divide
    the full turn; angles stay folded to the half turn, as the original has it,
    so only the lower half of the bins is used.
    gradients: images that sobel_gradients has been through, to share its work.
    """
    whole(cell_size, "cell_size", 1), whole(n_bins, "n_bins", 1), whole(block_size, "block_size", 1)
    turn = 360.0 if signed else 180.0
    vote = lambda magnitude, angle: {"hog": oriented(magnitude, angle, cell_size, n_bins, block_size, turn)}
    if gradients is not None:
        return on_stacks(gradients, lambda u8, m, a: vote(m, a), reads=("magnitude", "angle"), adds=("hog",)).select("image_id", "hog")

    def run(u8: bool, x: np.ndarray) -> dict[str, np.ndarray]:
        found = stack_gradients(x, "reflect")
        return vote(found["magnitude"], found["angle"])

    return on_stacks(images, run, adds=("hog",)).select("image_id", "hog")


def sobel_stats(images: DataFrame, gradients: DataFrame | None = None) -> DataFrame:
    """(image_id, mean, std, max) of the gradient magnitude."""
    rows = gradients if gradients is not None else sobel_gradients(images)
    n = F.size("magnitude")
    mean = F.aggregate("magnitude", F.lit(0.0), lambda a, v: a + v) / n
    rows = rows.withColumn("mag_mean", mean)
    std = F.sqrt(F.aggregate("magnitude", F.lit(0.0), lambda a, v: a + (v - F.col("mag_mean")) * (v - F.col("mag_mean"))) / n)
    return rows.select("image_id", "mag_mean", std.alias("mag_std"), F.array_max("magnitude").alias("mag_max"))


def quadrants(images: DataFrame, height: int, width: int) -> list[DataFrame]:
    """The four quarters, row by row; a remainder of an odd side is left out."""
    h, w = height // 2, width // 2
    return [crop(images, y * h, x * w, h, w) for y in range(2) for x in range(2)]


def spatial_color_histogram(images: DataFrame, height: int, width: int, bins: int = 16) -> DataFrame:
    """(image_id, quadrant, ch, counts): one scan, counted with the quadrant as a key."""
    h, w = height // 2, width // 2
    from ..model import to_pixels
    from .histogram import binned, shares

    pixels = to_pixels(images).filter((F.col("r") < 2 * h) & (F.col("c") < 2 * w))
    quadrant = (F.floor(F.col("r") / h) * 2 + F.floor(F.col("c") / w)).cast("int")
    return binned(pixels.withColumn("quadrant", quadrant), ["image_id", "quadrant", "ch"], bins).withColumn("counts", shares("counts"))


def feature_index(spark: SparkSession, hog_size: int = 324) -> DataFrame:
    """(feature_idx, name, family) of the assembled vector."""
    channels = ("R", "G", "B")
    names = [(f"fam1a_colorhist_{c}_bin{b:02d}", "fam1a") for c in channels for b in range(32)]
    names += [(f"fam1b_pixelstat_{s}_{c}", "fam1b") for c in channels for s in STATS]
    names += [(f"fam2a_hog_{k:04d}", "fam2a") for k in range(hog_size)]
    names += [(f"fam2b_sobel_{s}", "fam2b") for s in ("mag_mean", "mag_std", "mag_max")]
    names += [(f"fam3_lbp_bin{b:02d}", "fam3") for b in range(64)]
    names += [(f"fam4_spatial_q{q}_{c}_bin{b:02d}", "fam4") for q in range(4) for c in channels for b in range(16)]
    return spark.createDataFrame([(k, n, f) for k, (n, f) in enumerate(names)], "feature_idx int, name string, family string")


def binned_shares(x: np.ndarray, bins: int, top: float, closed: bool) -> np.ndarray:
    """Shares of equal bins over [0, top) by image and channel of a stack: (images, channels * bins); closed: top is in the last bin."""
    n, channels = len(x), x.shape[3]
    at = np.minimum(np.floor(x * bins / top), bins - 1).astype(np.int64)
    inside = (x >= 0) & ((x <= top) if closed else (x < top))
    at += (np.arange(n)[:, None, None, None] * channels + np.arange(channels)) * bins
    counts = np.bincount(at[inside], minlength=n * channels * bins).reshape(n, channels, bins).astype(float)
    total = counts.sum(axis=2, keepdims=True)
    return (counts / np.where(total > 0, total, 1)).reshape(n, -1)


def moments(x: np.ndarray, u8: bool) -> np.ndarray:
    """The statistics STATS of each channel of a stack: (images, channels * 8)."""
    flat = x.reshape(len(x), -1, x.shape[3])
    mean, low, high = flat.mean(axis=1), flat.min(axis=1), flat.max(axis=1)
    d = flat - mean[:, None]
    m2, m3, m4 = ((d**k).mean(axis=1) for k in (2, 3, 4))
    flat_channel = low == high
    safe = np.where(flat_channel | (m2 <= 0), 1.0, m2)
    shape = lambda v: np.where(flat_channel | (m2 <= 0), 0.0, v)
    shares = binned_shares(np.floor(np.clip(x, 0, 255)) if u8 else x, 256, 256.0 if u8 else 1.0, not u8).reshape(len(x), x.shape[3], 256)
    entropy = -(shares * np.log2(np.where(shares > 0, shares, 1))).sum(axis=2) + 0.0
    return np.stack([mean, shape(np.sqrt(m2)), low, high, shape(m3 / safe**1.5), shape(m4 / safe**2 - 3), (flat * flat).sum(axis=1), entropy], axis=2).reshape(len(x), -1)


def assembled(u8: bool, x: np.ndarray, cell: int) -> np.ndarray:
    """The whole vector of each RGB image of a stack."""
    top = 256.0 if u8 else 1.0
    byte = x if u8 else np.floor(np.clip(x * 255, 0, 255))
    gray = half_even_bytes(sum(w * byte[..., ch : ch + 1] for ch, w in enumerate(LUMA)))
    found = stack_gradients(gray / 255, "reflect")
    magnitude = found["magnitude"].reshape(len(x), -1)
    h, w = x.shape[1] // 2, x.shape[2] // 2
    quarters = [binned_shares(x[:, y * h : (y + 1) * h, z * w : (z + 1) * w], 16, top, not u8) for y in range(2) for z in range(2)]
    parts = [
        binned_shares(x, 32, top, not u8),
        moments(x, u8),
        oriented(found["magnitude"], found["angle"], cell, 9, 2, 180.0),
        np.stack([magnitude.mean(axis=1), magnitude.std(axis=1), magnitude.max(axis=1)], axis=1),
        binned_shares(patterns(gray), 64, 256.0, False),
        *quarters,
    ]
    return np.concatenate(parts, axis=1)


def feature_vectors(images: DataFrame, cell_size: int) -> DataFrame:
    """(image_id, features) of RGB images: colour, statistics, gradients, patterns and colour by quadrant.

    A vector is worked out in its image's row, so there is no shuffle.
    """
    whole(cell_size, "cell_size", 1)
    return on_stacks(images, lambda u8, x: {"features": assembled(u8, x, cell_size)}, adds=("features",)).select("image_id", "features")
