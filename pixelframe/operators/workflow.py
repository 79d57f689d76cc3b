"""Whole workflows: from image files and annotations to training tensors and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stacks import on_stacks
from . import clustering, descriptors, draw, geometry, histogram, point, sampling, stencil


def preprocess(images: DataFrame, height: int = 128, width: int = 128) -> DataFrame:
    """Colour images of one size with their values spread over 0..255; images without spread are left out."""
    gray, colour = images.filter("n_channels = 1"), images.filter("n_channels = 3")
    rgb = point.gray_to_rgb(gray).unionByName(colour)
    return point.normalize(geometry.resize(rgb, height, width), "minmax", 0, 255, strict=False)


def annotated_splits(files: DataFrame, id_col: str, class_col: str) -> DataFrame:
    """As many files of every class as the smallest has, dealt into train, val and test."""
    return sampling.stratified_split(sampling.stratified_downsample(files, id_col, class_col), id_col, class_col)


def process_split(annotations: DataFrame, images: DataFrame, height: int = 128, width: int = 128) -> DataFrame:
    """Preprocessed images with the label of their file; files that could not be read are left out.

    annotations: (image_path, class_name, label); images: rows of read_images.
    """
    good = images.filter("error IS NULL").drop("error", "label").join(annotations.select(F.col("image_path").alias("origin"), "label"), "origin")
    order = ["image_id", "label", "height", "width", "n_channels", "dtype", "data"]
    return preprocess(good.select(*order), height, width)


def extract_split(images: DataFrame, cell_size: int = 32) -> DataFrame:
    """(image_id, label, features) of a split's images."""
    found = on_stacks(images, lambda u8, x: {"features": descriptors.assembled(u8, x, cell_size)}, adds=("features",))
    return found.select("image_id", "label", "features")


def showcase(images: DataFrame, text: str = "OK") -> DataFrame:
    """Each RGB image in five panels: blurred, its edges, its segments, equalised, and with a note."""
    blurred = stencil.gaussian_filter(images, 5, 1.2)
    gray = point.rgb_to_gray(blurred)
    panels = {
        "blurred": blurred,
        "edges": stencil.canny(gray, 40, 110),
        "segments": clustering.kmeans_segment(images, 5),
        "equalised": histogram.histogram_equalization(point.rgb_to_gray(images)),
        "annotated": draw.draw_text(images, text, 0, 0, 1, (255, 255, 255), channels=3),
    }
    rows = [x.select("image_id", "height", "width", "n_channels", "dtype", "data", F.lit(name).alias("panel")) for name, x in panels.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
