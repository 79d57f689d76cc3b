"""k nearest neighbours by Euclidean distance.

Training rows and queries are dealt into blocks by hash, and each pair of
blocks is a tile that one task compares as matrix products.  No pair is ever a
row: a tile gives the k best of each of its queries, and those are merged.
Nothing passes through the driver or is broadcast; a training row is sent once
for each block of queries, and a query once for each block of training rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import whole
from ..ship import ship

TRAIN_ROWS = 32_768
QUERY_ROWS = 8_192
AT_ONCE = 512  # queries whose distances are in memory together


def _vectors(found: pa.Table, column: str) -> np.ndarray:
    values = found.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def _tile(k: int):
    """Compares one block of queries with one of training rows."""

    def run(queries: pa.Table, train: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(queries) and len(train):
            ids, labels, vectors, q_ids, q_vectors = train.column("id").to_numpy(), train.column("label").to_numpy(), _vectors(train, "features"), queries.column("id").to_numpy(), _vectors(queries, "features")
            squares, most = (vectors**2).sum(axis=1), min(k, len(ids))
            for at in range(0, len(q_ids), AT_ONCE):
                q = q_vectors[at : at + AT_ONCE]
                # the product form only picks candidates; kept distances come from differences
                rough = squares[None, :] - 2 * (q @ vectors.T) + (q**2).sum(axis=1)[:, None]
                limit = np.partition(rough, most - 1, axis=1)[:, most - 1]
                slack = 1e-9 * (1 + np.abs(limit)) * max(1.0, float(squares.max()))
                for j in range(len(q)):
                    near = np.flatnonzero(rough[j] <= limit[j] + slack[j])
                    d = np.sqrt(((vectors[near] - q[j]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], d))[:k]
                    for values, new in zip(out, (np.full(len(best), q_ids[at + j]), ids[near][best], labels[near][best], d[best])):
                        values.append(new)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
        return pa.table([pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, kinds)], names=["id", "train_id", "label", "distance"])

    return run


def nearest(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, rank, train_id, label, distance): the k nearest of (id, label, features); ties by training id."""
    whole(k, "k", 1)
    ship(queries.sparkSession)
    rows = train.count()
    if not rows:
        raise ValueError("the model has not been fitted")
    across, down = -(-rows // TRAIN_ROWS), max(1, -(-queries.count() // QUERY_ROWS))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(block(down).alias("q"), each(across).alias("t"), "id", "features")
    right = train.select(each(down).alias("q"), block(across).alias("t"), F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "features")
    found = left.groupBy("q", "t").cogroup(right.groupBy("q", "t")).applyInArrow(_tile(k), "id long, train_id long, label int, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "train_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y_pred): the most frequent label, the smallest among equals."""
    counts = neighbours.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("y_pred"))


def predict(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return vote(nearest(train, queries, k), ["id"])


def sweep(train: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(k, accuracy) for each k, from one ranking of the largest."""
    ranked = nearest(train, queries, max(ks))
    each = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    voted = vote(each, ["id", "k"]).join(queries.select("id", F.col("label").alias("y_true")), "id")
    return voted.groupBy("k").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
