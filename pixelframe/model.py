"""The image relation and the image views of the driver's tables.

At rest an image is one row: image_id, label, height, width, n_channels, dtype
('u8' or 'f64') and data, its values row by row with channels side by side
(index (r * width + c) * n_channels + ch).  Operators on such rows are
projections: no shuffle, whatever the number of images.  Where positions must
be grouped, `to_pixels` gives one row for each value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.pixels import half_even, let

IMAGE_SCHEMA = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("n_channels", T.IntegerType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("data", T.ArrayType(T.DoubleType())),
    ]
)
SIDE = 8
MOSAIC = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_rows(df: DataFrame, height: int, width: int, channels: int, dtype: str, data: Column, image_id: Column, label: Column) -> DataFrame:
    return df.select(
        image_id.cast("long").alias("image_id"),
        label.cast("int").alias("label"),
        F.lit(height).alias("height"),
        F.lit(width).alias("width"),
        F.lit(channels).alias("n_channels"),
        F.lit(dtype).alias("dtype"),
        data.alias("data"),
    )


def _unit(data: Column) -> Column:
    """Values scaled to 0..1 by the image's least and largest; a constant image is all 0."""
    bounds = F.struct(data.alias("x"), F.array_min(data).alias("low"), F.array_max(data).alias("high"))
    return let(bounds, lambda b: F.transform(b["x"], lambda v: F.coalesce(F.try_divide(v - b["low"], b["high"] - b["low"]), F.lit(0.0))))


def gray8_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 float image for each embedding."""
    rows = table(spark, sf_dir, "embeddings")
    return image_rows(rows, SIDE, SIDE, 1, "f64", F.col("embedding").cast("array<double>"), F.col("vec_id"), F.col("label"))


def gray8_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray8_f(spark, sf_dir).withColumn("data", _unit(F.col("data")))


def as_u8(images: DataFrame) -> DataFrame:
    """0..1 images as rounded 0..255."""
    return images.withColumn("data", F.transform("data", lambda v: half_even(v * 255))).withColumn("dtype", F.lit("u8"))


def gray8_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_u8(gray8_01(spark, sf_dir))


def rgb8_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three gray images in a row as the channels of one; channels that the last one lacks are black."""
    gray = gray8_u8(spark, sf_dir)
    black = F.array_repeat(F.lit(0.0), SIDE * SIDE)
    plane = lambda ch: F.coalesce(F.max(F.when(F.col("image_id") % 3 == ch, F.col("data"))), black).alias(f"p{ch}")
    planes = gray.groupBy(F.expr("image_id div 3").alias("_id")).agg(*[plane(ch) for ch in range(3)], F.min("label").alias("label"))
    data = F.flatten(F.transform(F.arrays_zip("p0", "p1", "p2"), lambda x: F.array(x["p0"], x["p1"], x["p2"])))
    return image_rows(planes, SIDE, SIDE, 3, "u8", data, F.col("_id"), F.col("label"))


def gray64_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 embeddings as the rows of one image; rows that the last one lacks are 0 before it is scaled."""
    given = F.map_from_entries(F.collect_list(F.struct((F.col("vec_id") % MOSAIC).alias("r"), "embedding")))
    rows = table(spark, sf_dir, "embeddings").groupBy(F.expr(f"vec_id div {MOSAIC}").alias("_id")).agg(given.alias("rows"))
    blank = F.array_repeat(F.lit(0.0), MOSAIC)
    data = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(MOSAIC - 1).cast("long")), lambda r: F.coalesce(F.element_at("rows", r).cast("array<double>"), blank)))
    return as_u8(image_rows(rows, MOSAIC, MOSAIC, 1, "f64", data, F.col("_id"), F.lit(None)).withColumn("data", _unit(F.col("data"))))


def to_pixels(images: DataFrame, column: str = "data", value: str = "v") -> DataFrame:
    """One row for each value: (image_id, ch, r, c, v).

    The outer form, as the inner one adds a filter on the array's size, which
    is pushed below the projections and works the array out once more for it.
    """
    rows = images.select("image_id", "width", "n_channels", F.posexplode_outer(column).alias("i", value)).filter("i IS NOT NULL")
    return rows.select(
        "image_id",
        (F.col("i") % F.col("n_channels")).alias("ch"),
        F.expr("cast(i div n_channels div width as int)").alias("r"),
        F.expr("cast((i div n_channels) % width as int)").alias("c"),
        value,
    )


def to_images(pixels: DataFrame, dtype: str) -> DataFrame:
    """The inverse of to_pixels: pixels grouped by image, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("r", "c", "ch", "v")))
    rows = pixels.groupBy("image_id").agg(ordered.alias("p"), F.max("r").alias("r"), F.max("c").alias("c"), F.max("ch").alias("ch"))
    return rows.select(
        "image_id",
        F.lit(None).cast("int").alias("label"),
        (F.col("r") + 1).alias("height"),
        (F.col("c") + 1).alias("width"),
        (F.col("ch") + 1).alias("n_channels"),
        F.lit(dtype).alias("dtype"),
        F.transform("p", lambda x: x["v"].cast("double")).alias("data"),
    )
