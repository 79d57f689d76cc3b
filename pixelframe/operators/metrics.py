"""Evaluation of predictions: rows of (y_true, y_pred) with classes 0 .. C-1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def _cells(pairs: DataFrame) -> DataFrame:
    """(y_true, y_pred, n): the one pass over predictions that all reports share, as Spark reuses its shuffle."""
    return pairs.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pairs: DataFrame, classes: int) -> DataFrame:
    """(y_true, y_pred, n) for all pairs of classes."""
    spark = pairs.sparkSession
    spine = spark.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("y_true"), (F.col("id") % classes).cast("int").alias("y_pred"))
    counts = _cells(pairs)
    return spine.join(F.broadcast(counts.filter(F.col("y_true").between(0, classes - 1) & F.col("y_pred").between(0, classes - 1))), ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_report(pairs: DataFrame, classes: int) -> DataFrame:
    """(cls, support, precision, recall, f1) for every class; 0 where a denominator is 0."""
    cells = confusion_matrix(pairs, classes)
    # each cell counts for its row and its column: one aggregation instead of a join of two
    sides = cells.select(F.explode(F.array(F.struct(F.col("y_true").alias("cls"), F.lit(True).alias("row")), F.struct(F.col("y_pred").alias("cls"), F.lit(False).alias("row")))).alias("s"), "y_true", "y_pred", "n")
    hit = F.when(F.col("s.row") & (F.col("y_true") == F.col("y_pred")), F.col("n")).otherwise(0)
    rows = sides.groupBy(F.col("s.cls").alias("cls")).agg(F.sum(hit).alias("tp"), F.sum(F.when(F.col("s.row"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("s.row"), F.col("n")).otherwise(0)).alias("predicted"))
    rows = rows.withColumn("precision", _ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    return rows.select("cls", "support", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def summary(pairs: DataFrame, classes: int) -> DataFrame:
    """One row: accuracy and the macro and weighted means of the class report."""
    report = class_report(pairs, classes)
    weigh = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    means = [f(c).alias(f"{kind}_{c}") for kind, f in (("macro", F.avg), ("weighted", weigh)) for c in ("precision", "recall", "f1")]
    right = F.col("y_true") == F.col("y_pred")
    whole = _cells(pairs).agg((F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum(F.when(right.isNotNull(), F.col("n")))).alias("accuracy"))
    return whole.join(report.agg(*means))  # one row each


def report_json(pairs: DataFrame, classes: int, model: str) -> DataFrame:
    """One row with the whole report as JSON, shares to six digits."""
    rounded = lambda rows, *plain: [*plain, *[F.round(c, 6).alias(c) for c in rows.columns if c not in plain]]
    overall = summary(pairs, classes)
    overall = overall.select(F.struct(*rounded(overall)).alias("overall_metrics"))
    by_class = class_report(pairs, classes)
    by_class = by_class.select(*rounded(by_class, "cls", "support")).agg(F.array_sort(F.collect_list(F.struct("cls", "support", "precision", "recall", "f1"))).alias("class_metrics"))
    cells = confusion_matrix(pairs, classes).groupBy("y_true").agg(F.transform(F.array_sort(F.collect_list(F.struct("y_pred", "n"))), lambda x: x["n"]).alias("cells"))
    matrix = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("y_true", "cells"))), lambda x: x["cells"]).alias("confusion_matrix"))
    return overall.join(by_class).join(matrix).select(F.to_json(F.struct(F.lit(model).alias("model"), "overall_metrics", "class_metrics", "confusion_matrix")).alias("report"))


def per_class_accuracy(pairs: DataFrame, classes: int) -> DataFrame:
    return class_report(pairs, classes).select("cls", F.col("recall").alias("accuracy"))


def best_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The first key with the largest value."""
    return rows.agg(F.max_by(key, F.struct(F.col(value), -F.col(key))).alias(f"best_{key}"), F.max(value).alias(value))


def model_comparison(reports: dict[str, DataFrame], classes: int) -> DataFrame:
    """(model, accuracy, macro_f1) of several prediction tables."""
    rows = [summary(pairs, classes).select(F.lit(name).alias("model"), "accuracy", "macro_f1") for name, pairs in reports.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out
