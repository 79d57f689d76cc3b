"""Features of arriving images: the array operators are stateless maps, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import IMAGE_SCHEMA
from ..operators.descriptors import sobel_stats
from ..operators.point import valid_only


def image_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Image rows from Parquet files as they arrive."""
    return spark.readStream.schema(IMAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def edge_features(images: DataFrame) -> DataFrame:
    """Gradient statistics of each valid image."""
    return sobel_stats(valid_only(images))


def brightness_by_label(images: DataFrame, event_time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean brightness by label and time window; rows later than the watermark are left out."""
    mean = F.aggregate("data", F.lit(0.0), lambda a, v: a + v) / F.size("data")
    return images.withWatermark(event_time, late).groupBy(F.window(event_time, window), "label").agg(F.avg(mean).alias("brightness"), F.count(F.lit(1)).alias("n_images"))


def write_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
