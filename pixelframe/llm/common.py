"""What the operators share: table access, shared scratch tables and skew-safe joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

SLICE_ROWS = 256
BATCH_ROWS = 1024
BATCH_BYTES = "8m"
#: groups that hold more than one row in HOT_SHARE are joined by broadcast: there are at most HOT_SHARE of them
HOT_SHARE = 2000
#: ids that are broadcast at once: 16 MB of them
BROADCAST_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing lazy reads any more."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to what texts of any length leave room for."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: what empties the memories of words that operators keep in a worker process
FORGETS: list[Callable[[], None]] = []
_USER = ""


def give_back() -> None:
    """Returns this process's free memory to the system."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries keep what they have
        pass


def use_worker(user: str) -> None:
    """Empties a worker's memories when another operator's task starts in it, and gives their space back."""
    global _USER
    if user != _USER:
        for forget in FORGETS:
            forget()
        give_back()
        _USER = user


def mapped(df: DataFrame, function: Callable, schema: str, user: str = "") -> DataFrame:
    """mapInArrow with this package sent to the workers, which forget what other operators remembered there."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    user = user or function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_worker(user)
        yield from function(batches)

    return df.mapInArrow(run, schema)


def filtered(df: DataFrame, judge: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows whose text is judged True, all columns as they are, without a shuffle.

    judge() makes the function once in each task; it gets a list of texts.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge()
        for rows in slices(batches):
            yield rows.filter(pa.array(decide([x or "" for x in rows.column(at).to_pylist()]), pa.bool_()))

    return mapped(df, run, df.schema, judge.__module__)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids (doc_id); rows with a null id stay.

    Up to BROADCAST_IDS ids are broadcast, so texts stay where they are; more
    are met by a shuffle, in hash tables of ids, so texts are never sorted.
    """
    ids = stored(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "dropped-ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def rejected(marks: DataFrame) -> DataFrame:
    """The ids of marks (doc_id, kept) of which no row is kept: an id that several texts share stays while one of them does."""
    return marks.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor: how rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hint: str | None = "merge") -> DataFrame:
    """Inner join of rows with the one record of their group, safe for a group that holds most rows.

    Groups of more than total / HOT_SHARE rows number fewer than HOT_SHARE and
    are broadcast; the others are too small to skew a shuffled join.
    """
    least = max(total // HOT_SHARE, 1)
    large = groups.filter(F.col(size) > least)
    small = groups.filter(F.col(size) <= least)
    keys = F.broadcast(large.select(key))
    hot = rows.join(F.broadcast(large), key)
    cold = rows.join(keys, key, "left_anti").join(small.hint(hint) if hint else small, key)
    return hot.unionByName(cold)
