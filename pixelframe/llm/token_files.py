"""Token ids in ORC files: one row for each document, in ascending id order.

Layout: (doc_id, at, n_tokens, ids).  ids are ORC integer runs (RLE version
2); at is the number of ids before the row in its own file.  Row indexes and
Bloom filters on doc_id let a reader skip stripes and row groups; a stripe is
read without any other.  File bases come from the files' own totals, a number
for each file.

Rows are dealt to files by ranges of doc_id, and within one id of rows,
which stay even under any hot source and any repeated id; texts are
shuffled once, ids never.

Defined results: null text is empty and has the end id only; null ids come
first; repeated ids keep all their rows side by side; empty tables give an
empty file set and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, new_path, slices, stored, table, text_of
from .encoders import encoder

END_ID = 1
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
BROADCAST_FILES = 100_000  # paths and totals: 30 MB of them
FILE_SCHEMA = "doc_id long, at long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, spaces: bool = False) -> None:
    """Encodes whole texts and writes them to path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, at, end = encoder(vocabulary, spaces), 0, np.array([end_id], "<u4").tobytes()
        for rows in slices(batches):
            packed = [codec.encode(text) + end for text in rows.column(1).to_pylist()]
            sizes = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(at + ends - sizes), pa.array(sizes), ids], ["doc_id", "at", "n_tokens", "ids"])
            at += int(ends[-1])

    (
        docs.select("doc_id", text_of().alias("text"))
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
        .transform(mapped, encode, FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.create.index", "true")
        .option("compression", "zstd")
        .orc(path)
    )


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with their global start; filters on doc_id reach the stripes' metadata."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def file_bases(spark: SparkSession, path: str) -> DataFrame:
    """For each file the ids before it, from the files' totals: (file, base)."""
    totals = open_tokens(spark, path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum("n_tokens").alias("total"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first"), F.max("doc_id").alias("last"))
    before = Window.orderBy("first", F.col("last").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 1024):
            ids = rows.column(3)
            flat, at = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<i4")), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    read = open_tokens(spark, path)
    bases = stored(file_bases(spark, path), "file-bases")
    # one record for each file: as many as the writing tasks, whatever the rows
    few = bases.count() <= BROADCAST_FILES
    return (
        read.select("doc_id", "at", F.col("_metadata.file_path").alias("file"), "ids")
        .join(F.broadcast(bases) if few else bases.hint("shuffle_hash"), "file")
        .select("doc_id", (F.col("at") + F.col("base")).alias("start"), F.lit(0).alias("unused"), "ids")
        .transform(mapped, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, path)
