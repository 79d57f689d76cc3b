"""Histograms and what follows from them.

Values are counted with one pre-aggregated groupBy: an image's values lie in
one row, so the partial aggregate is already complete and the shuffle carries
at most one record for each bin.  Levels of an image that its own pixels are
compared with (Otsu, equalisation) are worked out in the image's row, without a
join or shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import whole
from ..functions.pixels import clamp, let
from ..functions.stacks import half_even_bytes, on_stacks
from ..model import to_pixels
from .stencil import lbp_codes

STATS = ("mean", "std", "min", "max", "skewness", "kurtosis", "energy", "entropy")


def _dense(counts: str, bins: int) -> Column:
    """Counts by bin from a map, 0 where a bin is missing."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at(counts, b), F.lit(0).cast("long")))


def binned(pixels: DataFrame, keys: list[str], bins: int, top: float = 256.0, closed: bool = False) -> DataFrame:
    """(keys, counts ARRAY): values in [0, top) by equal bins; with `closed` the top belongs to the last bin."""
    inside = (F.col("v") >= 0) & ((F.col("v") <= top) if closed else (F.col("v") < top))
    bin_ = F.least(F.floor(F.col("v") * bins / top).cast("int"), F.lit(bins - 1))
    found = pixels.filter(inside).groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")).select(*keys, _dense("m", bins).alias("counts"))


def histogram(images: DataFrame, bins: int = 256) -> DataFrame:
    """(image_id, counts, edges) of gray u8 images."""
    whole(bins, "bins", 1)
    edges = F.array(*[F.lit(256.0 * k / bins) for k in range(bins + 1)])
    return binned(to_pixels(images), ["image_id"], bins).withColumn("edges", edges)


def shares(counts: str) -> Column:
    """Counts over their sum; all 0 where there is nothing to count."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(total.cast("double"), lambda t: F.transform(counts, lambda n: F.coalesce(F.try_divide(n.cast("double"), t), F.lit(0.0))))


def color_histogram(images: DataFrame, bins: int = 32, normalize: bool = True, dtype: str = "u8") -> DataFrame:
    """(image_id, ch, counts): for each channel, over [0, 256) or, for floats, [0, 1]."""
    found = binned(to_pixels(images), ["image_id", "ch"], whole(bins, "bins", 1), 256.0 if dtype == "u8" else 1.0, dtype != "u8")
    return found.withColumn("counts", shares("counts")) if normalize else found


def pixel_statistics(images: DataFrame, dtype: str = "u8") -> DataFrame:
    """(image_id, ch, eight statistics): population moments, energy, and entropy in bits over 256 bins."""
    pixels = to_pixels(images)
    bin_ = F.when(F.lit(dtype == "u8"), F.floor(clamp(F.col("v"), 0, 255))).otherwise(F.least(F.floor(F.col("v") * 256), F.lit(255))).cast("int")
    inside = (F.col("v") >= 0) & (F.col("v") <= (255.999 if dtype == "u8" else 1.0))
    # one pass: power sums for each bin roll up to the channel, and the bins' sizes give the entropy
    v = F.col("v")
    by_bin = pixels.withColumn("bin", F.when(inside, bin_)).groupBy("image_id", "ch", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.pow(v, k) if k > 1 else v).alias(f"s{k}") for k in range(1, 5)], F.min("v").alias("low"), F.max("v").alias("high"))
    sizes = F.collect_list(F.when(F.col("bin").isNotNull(), F.col("n")))
    rows = by_bin.groupBy("image_id", "ch").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(1, 5)], F.min("low").alias("min"), F.max("high").alias("max"), sizes.alias("sizes"))
    mean = F.col("s1") / F.col("n")
    m2 = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))
    m3 = F.col("s3") / F.col("n") - 3 * mean * F.col("s2") / F.col("n") + 2 * mean * mean * mean
    m4 = F.col("s4") / F.col("n") - 4 * mean * F.col("s3") / F.col("n") + 6 * mean * mean * F.col("s2") / F.col("n") - 3 * mean * mean * mean * mean
    flat = F.col("min") == F.col("max")
    entropy = F.aggregate("sizes", F.lit(0.0), lambda a, s: a - s / F.col("n") * F.log2(s / F.col("n")))
    return rows.select(
        "image_id",
        "ch",
        mean.alias("mean"),
        F.when(flat, 0.0).otherwise(F.sqrt(m2)).alias("std"),
        "min",
        "max",
        F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(m3, F.pow(m2, F.lit(1.5))), F.lit(0.0))).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(m4, m2 * m2) - 3, F.lit(0.0))).alias("kurtosis"),
        F.col("s2").alias("energy"),
        (entropy + 0.0).alias("entropy"),
    )


def level_counts(x: np.ndarray) -> np.ndarray:
    """How many values of each image of a stack have each of 256 levels: (images, 256)."""
    flat = np.floor(x.reshape(len(x), -1)).astype(np.int64)
    inside = (flat >= 0) & (flat < 256)
    return np.bincount((np.arange(len(x))[:, None] * 256 + flat)[inside], minlength=len(x) * 256).reshape(len(x), 256)


def otsu_levels(x: np.ndarray) -> np.ndarray:
    """For each image the first level with the largest variance between the classes.

    The variance is compared as (mu n0 - m N)^2 / (n0 n1) with counts, so ties are exact.
    """
    counts = level_counts(x)
    n0, m = counts.cumsum(axis=1).astype(float), (counts * np.arange(256)).cumsum(axis=1).astype(float)
    n, mu = n0[:, -1:], m[:, -1:]
    d, below = mu * n0 - m * n, n0 * (n - n0)
    return np.argmax(np.where(below > 0, d * d / np.where(below > 0, below, 1), 0.0), axis=1)


def with_otsu(images: DataFrame) -> DataFrame:
    """Adds threshold, each image's own level, to the image's row."""
    found = on_stacks(images, lambda u8, x: {"_level": otsu_levels(x)[:, None].astype(float)}, adds=("_level",))
    return found.withColumn("threshold", F.get("_level", F.lit(0)).cast("int")).drop("_level")


def otsu_thresholds(images: DataFrame) -> DataFrame:
    """(image_id, threshold) of gray u8 images."""
    return with_otsu(images).select("image_id", "threshold")


def threshold_otsu(images: DataFrame, max_val: float = 255) -> DataFrame:
    """Images thresholded at their own level, with the level as a column."""
    if max_val <= 0:
        raise ValueError("max_val must be positive")
    return with_otsu(images).withColumn("data", F.transform("data", lambda v: F.when(v > F.col("threshold"), F.lit(float(max_val))).otherwise(0.0)))


def equalization_levels(x: np.ndarray) -> np.ndarray:
    """The new value of each of 256 levels, for each image of a stack."""
    cum = level_counts(x).cumsum(axis=1).astype(float)
    share = cum / cum[:, -1:]
    low = np.where(cum > 0, share, 2.0).min(axis=1, keepdims=True)
    return half_even_bytes(np.round(255 * (share - low) / np.maximum(1 - low, 1e-9), 9))


def equalization_tables(images: DataFrame) -> DataFrame:
    """(image_id, lut): the new value of each of 256 levels."""
    return on_stacks(images, lambda u8, x: {"lut": equalization_levels(x)}, adds=("lut",)).select("image_id", "lut")


def histogram_equalization(images: DataFrame) -> DataFrame:
    def equalized(u8: bool, x: np.ndarray) -> dict[str, np.ndarray]:
        levels = np.clip(np.floor(x), 0, 255).astype(int).reshape(len(x), -1)
        return {"data": np.take_along_axis(equalization_levels(x), levels, axis=1).reshape(x.shape)}

    return on_stacks(images, equalized)


def lbp_descriptor(images: DataFrame, n_bins: int = 256, normalize: bool = True) -> DataFrame:
    """(image_id, counts) of the local binary patterns of gray images."""
    found = binned(to_pixels(lbp_codes(images)), ["image_id"], whole(n_bins, "n_bins", 1))
    return found.withColumn("counts", shares("counts")) if normalize else found


def foreground_by_label(images: DataFrame) -> DataFrame:
    """Share of pixels above the Otsu level, by label."""
    share = F.aggregate("data", F.lit(0.0), lambda a, v: a + F.when(v > 0, 1.0).otherwise(0.0))
    rows = threshold_otsu(images).select("label", share.alias("on"), F.size("data").alias("n"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_images"), (F.sum("on") / F.sum("n")).alias("foreground"))
