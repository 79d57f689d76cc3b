"""Whole-image operators in numpy: the images of an Arrow batch that have one shape are one stack.

An image is one row, so a stack operator is a projection: no shuffle, whatever
the number of images, and a task holds one batch of at most BATCH_BYTES.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..ship import ship

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "32m"
SHAPE = ("height", "width", "n_channels")


def half_even_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255)


def restored(x: np.ndarray, u8: bool) -> np.ndarray:
    """x as the image's type stores it; sums in another order may miss a half by an ulp, so noise is rounded off first."""
    x = np.round(x, 9)
    return half_even_bytes(x) if u8 else x


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Indices with the border mirrored, the edge itself not repeated."""
    if n == 1:
        return np.zeros_like(i)
    m = np.mod(i, 2 * (n - 1))
    return np.where(m < n, m, 2 * (n - 1) - m)


def padded(x: np.ndarray, h: int, w: int, mode: str, constant: float = 0.0) -> np.ndarray:
    """Stacks (images, rows, columns, channels) grown by h rows and w columns on each side."""
    if not h and not w:
        return x
    if mode == "constant":
        return np.pad(x, ((0, 0), (h, h), (w, w), (0, 0)), constant_values=constant)
    place = mirrored if mode == "reflect" else lambda i, n: np.clip(i, 0, n - 1)
    rows, cols = place(np.arange(-h, x.shape[1] + h), x.shape[1]), place(np.arange(-w, x.shape[2] + w), x.shape[2])
    return x[:, rows][:, :, cols]


def on_stacks(images: DataFrame, change: Callable[..., dict[str, np.ndarray]], reads: tuple[str, ...] = ("data",), adds: tuple[str, ...] = (), dtype: str | None = None) -> DataFrame:
    """The rows of images with what change gives for stacks of images of one shape.

    change(u8, *stacks of the columns of reads) returns stacks by column: those
    named in adds, or else `data`, whose shape becomes the image's, and dtype its
    type.  Images without data, or whose data is not of their shape, get nulls.
    """
    ship(images.sparkSession)
    if LIMIT not in images.sparkSession.conf.getAll:
        images.sparkSession.conf.set(LIMIT, BATCH_BYTES)  # where nobody has set one
    names = [*images.columns, *[c for c in adds if c not in images.columns]]
    kinds = {f.name: f.dataType for f in images.schema}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.ArrayType(T.DoubleType()))) for c in names])
    at = {c: k for k, c in enumerate(images.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _changed(batch, at, names, change, reads, adds, dtype)

    return images.mapInArrow(run, schema)


def _changed(batch: pa.RecordBatch, at: dict[str, int], names: list[str], change: Callable, reads: tuple[str, ...], adds: tuple[str, ...], dtype: str | None) -> pa.RecordBatch:
    shape = np.stack([pc.fill_null(batch.column(at[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in SHAPE], axis=1)
    u8 = pc.fill_null(pc.equal(batch.column(at["dtype"]), "u8"), False).to_numpy(zero_copy_only=False)
    flats, starts, good = [], [], shape.prod(axis=1) > 0
    for c in reads:
        lengths = pc.fill_null(pc.list_value_length(batch.column(at[c])), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flats.append(pc.list_flatten(batch.column(at[c])).to_numpy(zero_copy_only=False).astype(float))
        starts.append(np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0))
        good &= lengths == shape.prod(axis=1)
    groups, of = np.unique(np.column_stack((shape, u8))[good], axis=0, return_inverse=True)
    rows, found = np.flatnonzero(good), {}
    for k, (h, w, n, byte) in enumerate(groups):
        mine = rows[of.ravel() == k]
        size = h * w * n
        stacks = []
        for flat, start in zip(flats, starts):
            begin = start[mine]
            run = flat[begin[0] : begin[0] + len(mine) * size] if (np.diff(begin) == size).all() else flat[begin[:, None] + np.arange(size)]
            stacks.append(run.reshape(len(mine), h, w, n))
        for c, stack in change(bool(byte), *stacks).items():
            found.setdefault(c, []).append((mine, stack))
    columns = {c: batch.column(k) for c, k in at.items()}
    for c, parts in found.items():
        lengths, there = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
        for mine, stack in parts:
            lengths[mine], there[mine] = stack[0].size, True
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        values = np.empty(offsets[-1])
        for mine, stack in parts:
            size = stack[0].size
            if len(parts) == 1 and size:
                values[:] = stack.ravel()
            else:
                values[offsets[mine][:, None] + np.arange(size)] = stack.reshape(len(mine), size)
            if c == "data":
                shape[mine] = stack.shape[1:]
        columns[c] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=pa.array(~there))
    for c in set(adds or ("data",)) - set(found):
        columns[c] = pa.nulls(batch.num_rows, pa.list_(pa.float64()))
    for k, c in enumerate(SHAPE):
        columns[c] = pa.array(shape[:, k], batch.column(at[c]).type)
    if dtype is not None:
        columns["dtype"] = pa.array([dtype] * batch.num_rows, pa.string())
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)
