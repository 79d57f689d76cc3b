"""A reader and writer of .npy arrays: one row for each entry of the first axis, read by ranges of rows, written a file for each task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS = 65_536


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, before: int):
        self.path, self.begin, self.end, self.before = path, begin, end, before


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _files(self) -> list[str]:
        """The file itself, or the .npy files of a folder by name."""
        from pyarrow import fs

        store, base = _store(self.path)
        if store.get_file_info(base).type != fs.FileType.Directory:
            return [base]
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".npy"))

    def _open(self, file: str):
        return _store(self.path)[0].open_input_file(file)

    @staticmethod
    def _header(stream) -> tuple[tuple[int, ...], object, int]:
        import numpy as np

        version = np.lib.format.read_magic(stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(stream)
        if fortran or dtype.hasobject:
            raise ValueError("only C-ordered numeric arrays are read")
        return shape, dtype, stream.tell()

    def partitions(self):
        out, before = [], 0
        for file in self._files():
            with self._open(file) as stream:
                shape, _, _ = self._header(stream)
            n = shape[0] if shape else 1
            out += [Range(file, at, min(at + ROWS, n), before) for at in range(0, n, ROWS)]
            before += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition):
        import math

        import numpy as np
        import pyarrow as pa

        if partition.begin == partition.end:
            return
        with self._open(partition.path) as stream:
            shape, dtype, start = self._header(stream)
            each = math.prod(shape[1:]) if shape else 1
            for at in range(partition.begin, partition.end, 1024):
                n = min(1024, partition.end - at)
                stream.seek(start + at * each * dtype.itemsize)
                values = np.frombuffer(stream.read(n * each * dtype.itemsize), dtype).astype(float)
                data = pa.ListArray.from_arrays(pa.array(np.arange(0, n * each + 1, each, dtype=np.int32) if each else np.zeros(n + 1, np.int32)), pa.array(values))
                dims = pa.array([list(shape[1:])] * n, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n) + partition.before), dims, data], ["row", "shape", "data"])


class NpyWriter(DataSourceArrowWriter):
    """Each task's rows as one array file: part-<task>.npy."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        import io

        import numpy as np
        from pyspark import TaskContext

        parts = [np.stack(batch.column(0).to_numpy(zero_copy_only=False)) for batch in iterator if batch.num_rows]
        if parts:
            store, base = _store(self.path)
            store.create_dir(base, recursive=True)
            held = io.BytesIO()
            np.save(held, np.concatenate(parts))
            with store.open_output_stream(f"{base}/part-{TaskContext.get().partitionId():05d}.npy") as out:
                out.write(held.getbuffer())
        return WriterCommitMessage()


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "row long, shape array<int>, data array<double>"

    def reader(self, schema):
        return NpyReader(self.options["path"])

    def writer(self, schema, overwrite):
        return NpyWriter(self.options["path"])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    from ..ship import ship

    ship(spark)
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(path)


def write_npy(rows: DataFrame, column: str, path: str) -> None:
    """The arrays of a column, all of one length, as .npy files of a folder."""
    from ..ship import ship

    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(NpySource)
    rows.select(column).write.format("npy").mode("append").save(path)
