"""Sampling, splitting, shuffling and ranking by a hash of the row's id.

md5 order is the same in every run and engine.  Ranks within a class are found
in two steps so that a class holding most rows is not sorted in one task: rows
are counted by class and leading hash digits, and only rows of one digit group
are ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3
SPLITS = 128


def order_key(id_col: str, seed: str = "") -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds rank (from 1) and total within keys by `_part`, then order; only rows of one part are sorted together."""
    parts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    by_keys = Window.partitionBy(*keys)
    before = by_keys.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(by_keys).alias("total"))
    numbered = rows.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return numbered.join(parts, [*keys, "_part"]).withColumn("rank", F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before")


def ranked(rows: DataFrame, id_col: str, keys: list[str], seed: str = "") -> DataFrame:
    """Adds rank (from 1) and total of each row within its keys, by md5 order."""
    rows = rows.withColumn("_key", order_key(id_col, seed)).withColumn("_part", F.substring("_key", 1, DIGITS))
    return _numbered(rows, keys, ["_key", id_col]).drop("_key")


def class_distribution(rows: DataFrame, class_col: str) -> DataFrame:
    return rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))


def stratified_downsample(rows: DataFrame, id_col: str, class_col: str, seed: str = "") -> DataFrame:
    """As many rows of every class as the smallest has."""
    least = class_distribution(rows, class_col).agg(F.min("n").alias("least"))
    return ranked(rows, id_col, [class_col], seed).join(F.broadcast(least)).filter("rank <= least").drop("rank", "total", "least")


def stratified_split(rows: DataFrame, id_col: str, class_col: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: str = "") -> DataFrame:
    """Adds split: train, val or test, with whole-number shares of every class."""
    if abs(sum(ratios) - 1) > 1e-9 or min(ratios) < 0:
        raise ValueError("ratios must sum to 1")
    train, val = F.floor(F.col("total") * ratios[0]), F.floor(F.col("total") * ratios[1])
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")
    return ranked(rows, id_col, [class_col], seed).withColumn("split", split).drop("rank", "total")


def sample_exact(rows: DataFrame, id_col: str, n: int, seed: str = "") -> DataFrame:
    """Exactly n rows without replacement."""
    if rows.count() < n:
        raise ValueError("fewer rows than asked for")
    return rows.orderBy(order_key(id_col, seed), id_col).limit(n)


def shuffled(rows: DataFrame, id_col: str, seed: str = "") -> DataFrame:
    return rows.orderBy(order_key(id_col, seed), id_col)


def choice(id_col: str, n: int, seed: str = "") -> Column:
    """A number in 0..n-1 drawn from the id."""
    return (F.conv(F.substring(order_key(id_col, seed), 1, 8), 16, 10).cast("long") % n).cast("int")


def head(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    return rows.orderBy(id_col).limit(n)


def tail(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(id_col)).limit(n).orderBy(id_col)


def rename_plan(files: DataFrame) -> DataFrame:
    """(old_path, new_path) for (class_name, name, ext): class and running number by name.

    Names are cut into parts between SPLITS names drawn by hash, so that a class
    holding most files is not sorted in one task; which names are drawn matters
    for balance only.
    """
    drawn = [r[0] for r in files.select("name").orderBy(F.md5("name"), "name").limit(SPLITS).collect()]
    part = F.size(F.filter(F.array(*[F.lit(x) for x in drawn]), lambda x: x <= F.col("name"))) if drawn else F.lit(0)
    rows = _numbered(files.withColumn("_part", part), ["class_name"], ["name"])
    old = F.concat_ws("/", "class_name", F.concat("name", "ext"))
    new = F.concat("class_name", F.lit("/"), "class_name", F.lit("_"), F.format_string("%04d", F.col("rank")), "ext")
    return rows.select(old.alias("old_path"), new.alias("new_path"))
