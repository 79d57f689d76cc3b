"""Point operators: each output value depends on the value at its place and on its image's extremes.

All are projections of image rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import one_of, whole
from ..functions.pixels import clamp, each_pixel, half_even, known, let, typed
from ..functions.stacks import on_stacks

LUMA = (0.299, 0.587, 0.114)  # fixed values: weights of red, green and blue


def _map(images: DataFrame, value, dtype: str | None = None) -> DataFrame:
    out = images.withColumn("data", F.transform("data", value))
    return out if dtype is None else out.withColumn("dtype", F.lit(dtype))


def is_u8() -> Column:
    return F.col("dtype") == "u8"


def validate_images(images: DataFrame, allow_gray: bool = True, allow_rgb: bool = True) -> DataFrame:
    """Adds error: null for a proper image, else what is wrong with it."""
    size = F.col("height") * F.col("width") * F.col("n_channels")
    error = F.when(F.col("data").isNull(), "no data").when(~F.col("n_channels").isin(1, 3), "channels must be 1 or 3").when(F.size("data") != size, "data does not fit the shape")
    if not allow_gray:
        error = error.when(F.col("n_channels") == 1, "gray is not allowed")
    if not allow_rgb:
        error = error.when(F.col("n_channels") == 3, "colour is not allowed")
    return images.withColumn("error", error)


def valid_only(images: DataFrame) -> DataFrame:
    return validate_images(images).filter("error IS NULL").drop("error")


def to_float64(images: DataFrame) -> DataFrame:
    """0..255 becomes 0..1; float images that leave 0..1 are clipped."""
    return _map(images, lambda v: F.when(is_u8(), v / 255).otherwise(clamp(v, 0, 1)), "f64")


def to_uint8(images: DataFrame) -> DataFrame:
    """Float images are scaled by 255 only if all their values are in 0..1."""
    scale = F.when((F.array_min("data") >= 0) & (F.array_max("data") <= 1), 255.0).otherwise(1.0)
    data = let(scale, lambda k: F.transform("data", lambda v: F.when(is_u8(), v).otherwise(clamp(half_even(v * k), 0, 255))))
    return images.withColumn("data", data).withColumn("dtype", F.lit("u8"))


def normalize(images: DataFrame, mode: str = "minmax", low: float = 0.0, high: float = 255.0, strict: bool = True) -> DataFrame:
    """Rescales by the image's own statistics over all channels, or by a fixed divisor.

    An image without spread has no result: an error when strict, else it is dropped.
    """
    mode = one_of(mode.lower(), ("minmax", "zscore", "fixed"), "mode")
    if mode == "fixed":
        if high == 0:
            raise ValueError("high must not be 0")
        return _map(images, lambda v: v / F.lit(float(high)), "f64")
    n = F.size("data")
    mean = F.aggregate("data", F.lit(0.0), lambda a, v: a + v) / n
    if mode == "minmax":
        base, spread = F.array_min("data"), F.array_max("data") - F.array_min("data")
    else:
        base, spread = mean, let(mean, lambda x: F.sqrt(F.aggregate("data", F.lit(0.0), lambda a, v: a + (v - x) * (v - x)) / n))
    rows = images.withColumn("_base", base).withColumn("_spread", spread)
    if strict:
        rows = rows.withColumn("_spread", F.when(F.col("_spread") == 0, F.raise_error(F.lit("an image without spread cannot be normalised"))).otherwise(F.col("_spread")))
    rows = rows.filter("_spread <> 0")
    base = F.col("_base")
    if mode == "zscore":
        return _map(rows, lambda v: (v - base) / F.col("_spread"), "f64").drop("_base", "_spread")
    keeps = is_u8() & F.lit((low, high) == (0.0, 255.0))
    scaled = _map(rows, lambda v: typed((v - base) / F.col("_spread") * (high - low) + low, F.when(keeps, F.lit("u8")).otherwise("f64")))
    return scaled.withColumn("dtype", F.when(keeps, "u8").otherwise("f64")).drop("_base", "_spread")


def clip_pixels(images: DataFrame, low: float = 0, high: float = 255) -> DataFrame:
    if low > high:
        raise ValueError("low must not exceed high")
    return _map(images, lambda v: clamp(v, low, high))


def rgb_to_gray(images: DataFrame) -> DataFrame:
    def value(r: Column, c: Column, ch: Column) -> Column:
        i = (r * F.col("width") + c) * 3
        return typed(sum((F.get("data", i + k) * w for k, w in enumerate(LUMA)), F.lit(0.0)), F.col("dtype"))

    return images.withColumn("data", each_pixel(value, F.col("height"), F.col("width"), F.lit(1))).withColumn("n_channels", F.lit(1))


def gray_to_rgb(images: DataFrame) -> DataFrame:
    return images.withColumn("data", F.flatten(F.transform("data", lambda v: F.array(v, v, v)))).withColumn("n_channels", F.lit(3))


def threshold_global(images: DataFrame, thresh: float, max_val: float = 255, invert: bool = False) -> DataFrame:
    """max_val where a value is above the threshold (inverted: not above it), else 0."""
    if max_val <= 0:
        raise ValueError("max_val must be positive")
    return _map(images, lambda v: F.when((v <= thresh) if invert else (v > thresh), F.lit(float(max_val))).otherwise(0.0))


def bit_plane_slice(images: DataFrame, plane: int) -> DataFrame:
    if whole(plane, "plane", 0) > 7:
        raise ValueError("plane must be in 0..7")
    return _map(images, lambda v: F.when(F.shiftright(v.cast("int"), plane).bitwiseAND(1) == 1, 255.0).otherwise(0.0))


def brightness(images: DataFrame, delta: float) -> DataFrame:
    return _map(images, lambda v: F.floor(clamp(v + delta, 0, 255)).cast("double"), "u8")


def hflip(images: DataFrame) -> DataFrame:
    return on_stacks(images, lambda u8, x: {"data": x[:, :, ::-1]})


def channels_first(images: DataFrame) -> DataFrame:
    """data reordered to index ch * height * width + r * width + c."""
    area = F.col("height") * F.col("width")
    planes = F.transform(F.sequence(F.lit(0), F.col("n_channels") - 1), lambda ch: F.transform(F.sequence(F.lit(0), area - 1), lambda p: F.get("data", p * F.col("n_channels") + ch)))
    return images.withColumn("data", known(F.flatten(planes), "data"))


def finite(images: DataFrame, column: str = "data") -> DataFrame:
    """NaN and infinities become 0."""
    bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    return images.withColumn(column, F.transform(column, lambda v: F.when(bad(v), 0.0).otherwise(v)))


def rectify(images: DataFrame) -> DataFrame:
    """Absolute values clipped to 0..255 and truncated, for display."""
    return _map(images, lambda v: F.floor(clamp(F.abs(v), 0, 255)).cast("double"), "u8")


def display_rescale(images: DataFrame) -> DataFrame:
    bounds = F.struct(F.array_min("data").alias("low"), F.array_max("data").alias("high"))
    data = let(bounds, lambda b: F.transform("data", lambda v: (v - b["low"]) / (b["high"] - b["low"] + 1e-8)))
    return images.withColumn("data", data).withColumn("dtype", F.lit("f64"))


def crop(images: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """Rows and columns of an image, as far as it has them."""
    return on_stacks(images, lambda u8, x: {"data": x[:, top : top + height, left : left + width]})


def salt_and_pepper(images: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A share of the values becomes 255 and as large a share 0, drawn by a hash of image, place and seed."""
    bits = lambda i: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("image_id"), i)), 1, 6), 16, 10).cast("double") / float(1 << 24)
    return images.withColumn("data", F.transform("data", lambda v, i: F.when(bits(i) < share, 255.0).when(bits(i) < 2 * share, 0.0).otherwise(v)))


def one_hot(labels: DataFrame, column: str, classes: int) -> DataFrame:
    return labels.withColumn("one_hot", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.col(column)).cast("int")))


def column_subset(rows: DataFrame, column: str, indices: list[int]) -> DataFrame:
    """The chosen entries of an array column, in the given order."""
    return rows.withColumn(column, F.array(*[F.get(column, F.lit(i)) for i in indices]))
