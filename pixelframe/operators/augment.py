"""Targeted augmentation: some images, one random change each, added to the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import rotate, translate
from .histogram import color_histogram, lbp_descriptor
from .point import brightness, hflip
from .sampling import choice, order_key
from .stencil import gaussian_filter

CHANGES = ("rotate", "translate", "blur", "bright", "flip")


def _change(images: DataFrame, k: int) -> DataFrame:
    return [
        lambda x: rotate(x, 15),
        lambda x: translate(x, 10, 10),
        lambda x: gaussian_filter(x, 3, 1.0),
        lambda x: brightness(x, 40),
        hflip,
    ][k](images)


def augmented(images: DataFrame, num: int, seed: str = "augment") -> DataFrame:
    """num images drawn by hash, each changed in one of five ways; adds change."""
    drawn = images.orderBy(order_key("image_id", seed), "image_id").limit(num).withColumn("_k", choice("image_id", len(CHANGES), seed))
    parts = [_change(drawn.filter(F.col("_k") == k), k).withColumn("change", F.lit(name)) for k, name in enumerate(CHANGES)]
    return reduce(DataFrame.unionByName, parts).drop("_k")


def with_augmented(images: DataFrame, num: int, seed: str = "augment") -> DataFrame:
    """The images and, after them, the augmented ones."""
    return images.withColumn("change", F.lit("none")).unionByName(augmented(images, num, seed))


def feature_panel(images: DataFrame, angle: float = 15) -> DataFrame:
    """(image_id, change, family, values): colours and patterns of every gray image as it is and turned, side by side."""
    parts = []
    for change, x in (("orig", images), ("rotate", rotate(images, angle))):
        for family, found in (("colour", color_histogram(x, 32)), ("patterns", lbp_descriptor(x, 64))):
            parts.append(found.select("image_id", F.lit(change).alias("change"), F.lit(family).alias("family"), F.col("counts").alias("values")))
    return reduce(DataFrame.unionByName, parts)


def panel(images: DataFrame) -> DataFrame:
    """Every image as it is and in five fixed changes."""
    changes = {"orig": images, "rotate": rotate(images, 17), "translate": translate(images, 5, 10), "blur": gaussian_filter(images, 5, 1.0), "bright": brightness(images, 30), "flip": hflip(images)}
    return reduce(DataFrame.unionByName, [x.withColumn("change", F.lit(k)) for k, x in changes.items()])
