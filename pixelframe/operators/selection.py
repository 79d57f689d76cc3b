"""Feature selection: ANOVA F relevance, Pearson redundancy, greedy quotient.

All rows are read once: sums by class and the product sums of all feature
pairs.  Features are a bounded number, so both fit the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import whole


def relevance(rows: DataFrame) -> DataFrame:
    """(feature_idx, f_stat) of rows (label, features); a feature without spread inside classes has 0."""
    values = rows.select("label", F.posexplode_outer("features").alias("feature_idx", "v"))
    by_class = values.groupBy("feature_idx", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    sums = by_class.groupBy("feature_idx").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count(F.lit(1)).alias("k"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return sums.select("feature_idx", F.coalesce(F.try_divide(between, within), F.lit(0.0)).alias("f_stat"))


def correlations(rows: DataFrame) -> np.ndarray:
    """Absolute Pearson correlations of all feature pairs, from partial product sums of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, None, None
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                n, s, q = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], ["n", "s", "q"])

    parts = rows.select("features").mapInArrow(run, "n long, s array<double>, q array<double>")
    n, s, q = 0, 0.0, 0.0
    for r in parts.toLocalIterator():  # one record for each task
        n, s, q = n + r["n"], s + np.array(r["s"]), q + np.array(r["q"])
    size = len(s)
    cov = q.reshape(size, size) / n - np.outer(s, s) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.abs(np.nan_to_num(cov / np.outer(sd, sd)))


def mrmr(rows: DataFrame, k: int) -> list[int]:
    """The k features chosen one by one for relevance over mean correlation with those chosen before."""
    whole(k, "k", 1)
    f = {r["feature_idx"]: r["f_stat"] for r in relevance(rows).collect()}
    score = np.array([f[i] for i in range(len(f))])
    r = correlations(rows)
    chosen: list[int] = []
    redundancy = np.zeros(len(score))
    while len(chosen) < min(k, len(score)):
        quotient = score if not chosen else score / np.maximum(redundancy / len(chosen), 1e-3)
        quotient = np.where(np.isin(np.arange(len(score)), chosen), -np.inf, quotient)
        chosen.append(int(np.argmax(quotient)))
        redundancy = redundancy + r[:, chosen[-1]]
    return chosen


def named(index: DataFrame, prefix: str = "", contains: str = "") -> DataFrame:
    """Features whose name starts with prefix and contains a text."""
    return index.filter(F.col("name").startswith(prefix) & F.col("name").contains(contains))


def members(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of index whose feature was chosen."""
    return index.join(F.broadcast(chosen.select("feature_idx")), "feature_idx", "left_semi")  # at most one record for each feature


def unselected(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """The features that were not chosen."""
    return index.select("feature_idx").exceptAll(chosen.select("feature_idx")).distinct()


def family_counts(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(family, n): chosen features of each family, 0 where none is."""
    hit = index.join(F.broadcast(chosen.select("feature_idx").withColumn("hit", F.lit(1))), "feature_idx", "left")
    return hit.groupBy("family").agg(F.count("hit").alias("n"))
