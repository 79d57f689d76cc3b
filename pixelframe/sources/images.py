"""Image files: reading with Spark's own source, writing PNG and JPEG, labelled folders, and tables of annotations."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import whole
from ..operators.point import rgb_to_gray
from ..ship import ship
from .jpeg import jpeg_bytes


DECODED = "image_id long, label int, height int, width int, n_channels int, dtype string, data array<double>, origin string, error string"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The source's bytes, blue, green, red (and alpha) of each pixel, as values of red, green and blue, or of gray."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows, out = batch.slice(at, 64), []
            for image_id, origin, h, w, n, data in zip(*(rows.column(k).to_pylist() for k in range(6))):
                if h <= 0 or w <= 0:
                    out.append((image_id, None, h, w, 3 if n >= 3 else 1, "u8", None, origin, f"cannot be decoded: {origin}"))
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                kept = pixels[:, :, 2::-1] if n >= 3 else pixels[:, :, :1]
                out.append((image_id, None, h, w, kept.shape[2], "u8", kept.ravel().astype(float), origin, None))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string())
            names = [x.split()[0] for x in DECODED.split(", ")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)


def read_images(spark: SparkSession, path: str, as_gray: bool = False, drop_invalid: bool = False) -> DataFrame:
    """Image rows with origin and error; files that cannot be decoded have an error (or are left out)."""
    if not isinstance(path, str):
        raise TypeError("path must be a string")
    raw = spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True).load(path).select("image.*")
    ship(spark)
    rows = raw.select(F.xxhash64("origin").alias("image_id"), "origin", "height", "width", "nChannels", "data").mapInArrow(_decoded, DECODED)
    if not as_gray:
        return rows
    colour = rgb_to_gray(rows.filter("n_channels = 3"))
    return rows.filter("n_channels = 1").unionByName(colour)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_bytes(values: np.ndarray, height: int, width: int, channels: int) -> bytes:
    """A PNG file of u8 values; gray images have one channel."""
    rows = values.astype(np.uint8).reshape(height, width * channels)
    filtered = np.concatenate((np.zeros((height, 1), np.uint8), rows), axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered)) + _chunk(b"IEND", b"")


ENCODERS = {".png": lambda v, h, w, n, quality: png_bytes(v, h, w, n), ".jpg": jpeg_bytes, ".jpeg": jpeg_bytes}


def encoded(images: DataFrame, extension: str = ".png", quality: int = 95) -> DataFrame:
    """(image_id, content): float images are scaled by 255 if their largest value is at most 1, and truncated."""
    ship(images.sparkSession)
    encode = ENCODERS[extension]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for h, w, n, kind, data in zip(*(rows.column(k).to_pylist() for k in range(1, 6))):
                v = np.array(data, float)
                if kind != "u8" and len(v) and v.max() <= 1:
                    v = v * 255
                out.append(encode(np.floor(np.clip(v, 0, 255)), h, w, n, quality))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.binary())], ["image_id", "content"])

    return images.select("image_id", "height", "width", "n_channels", "dtype", "data").mapInArrow(run, "image_id long, content binary")


def write_images(images: DataFrame, folder: str, extension: str = ".png", quality: int = 95) -> DataFrame:
    """Writes one file for each image through Arrow's file systems, so that any store works; returns (image_id, path)."""
    extension = extension.lower()
    if extension not in ENCODERS:
        raise ValueError("only .png, .jpg and .jpeg are written")
    if whole(quality, "quality", 1) > 95:
        raise ValueError("quality must be in 1..95")
    spark = images.sparkSession
    spark.dataSource.register(_file_sink())
    rows = encoded(images, extension, quality).select(F.concat(F.col("image_id").cast("string"), F.lit(extension)).alias("name"), "content")
    rows.write.format("image_files").mode("append").save(folder)
    return images.select("image_id", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image_id").cast("string"), F.lit(extension)).alias("path"))


def _file_sink():
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    class Writer(DataSourceArrowWriter):
        def __init__(self, folder: str):
            self.folder = folder

        def write(self, iterator):
            from pyarrow import fs

            store, base = fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + self.folder)
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    store.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                    with store.open_output_stream(f"{base}/{name}") as out:
                        out.write(content)
            return WriterCommitMessage()

    class ImageFiles(DataSource):
        @classmethod
        def name(cls):
            return "image_files"

        def writer(self, schema, overwrite):
            return Writer(self.options["path"])

    return ImageFiles


def write_labelled(images: DataFrame, folder: str, class_name) -> None:
    """PNG files in class folders."""
    spark = images.sparkSession
    spark.dataSource.register(_file_sink())
    names = images.select("image_id", class_name.alias("class_name"))
    rows = encoded(images).join(names, "image_id").select(F.concat(F.col("class_name"), F.lit("/"), F.col("image_id").cast("string"), F.lit(".png")).alias("name"), "content")
    rows.write.format("image_files").mode("append").save(folder)


def labelled_files(spark: SparkSession, folder: str) -> DataFrame:
    """(image_path, class_name, label) of the files in class folders; labels number the sorted class names.

    File contents are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    base = files.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    inner = F.regexp_extract("path", r"^(?:[a-zA-Z]+:)?/*(/.*)$", 1)
    rest = F.substring(inner, len(base) + 2, 1 << 20)
    rows = files.select(F.col("path").alias("image_path"), rest.alias("rest")).filter(F.col("rest").contains("/"))
    rows = rows.withColumn("class_name", F.split("rest", "/")[0])
    names = rows.select("class_name").distinct()
    from pyspark.sql import Window

    labels = names.withColumn("label", F.row_number().over(Window.orderBy("class_name")) - 1)  # one record for each class
    return rows.join(F.broadcast(labels), "class_name").select("image_path", "class_name", "label")


ANNOTATIONS = "image_path string, class_name string, label int"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATIONS).csv(path, header=True)


def write_annotations(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.select("image_path", "class_name", "label").write.option("header", True).mode(mode).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Training log rows as CSV, added to what is there."""
    rows.write.option("header", True).mode("append").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """A row for each line, as write_json writes them, or for each file."""
    return spark.read.json(path, multiLine=whole_files)
