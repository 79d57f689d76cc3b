"""Bounded samples of labelled rows for fitting classifiers.

Only rows whose crc32(doc_id as text) modulo HELD_OUT is not 0 are ever read
with their label.  A sample has at most `most` rows, those with the least hash
of their id, so it is the same however the tables are dealt; of those, texts
are taken until they have SAMPLE_BYTES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, remainder, stored, text_of

HELD_OUT = 5
SAMPLE_BYTES = 64 << 20


def held_out() -> F.Column:
    return (remainder("doc_id", HELD_OUT) == 0).alias("held_out")


def _least(rows: DataFrame, most: int) -> DataFrame:
    return rows.select("doc_id", *[c for c in rows.columns if c != "doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _texts(docs: DataFrame, ids: DataFrame) -> list:
    """Whole texts of at most a sample's ids: the ids are bounded, so they are broadcast and no text is shuffled twice."""
    rows = stored(docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]), "sample")
    left, taken = SAMPLE_BYTES, []
    for r in rows.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        left -= r["size"]
        if left < 0 and taken:
            break
        taken.append(r["doc_id"])
    found = rows.filter(F.col("doc_id").isin(taken)).orderBy("doc_id").collect() if taken else []
    discard(rows)
    return found


def labels_for_training(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of rows that may be learnt from; the largest label of a repeated id."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (remainder("doc_id", HELD_OUT) != 0))
    return usable.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> tuple[list[str], list[int], float]:
    """Texts and labels, half of each label where there are enough, and the share of label 1 among all that may be learnt from."""
    usable = labels_for_training(labels, column)
    share = usable.agg(F.avg("label")).first()[0]
    ids = _least(usable.filter("label = 1"), most // 2).unionByName(_least(usable.filter("label = 0"), most // 2))
    rows = _texts(docs, ids)
    return [r["text"] for r in rows], [r["label"] for r in rows], 0.5 if share is None else float(share)


def positive_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> tuple[list[str], float]:
    usable = labels_for_training(labels, column)
    share = usable.agg(F.avg("label")).first()[0]
    return [r["text"] for r in _texts(docs, _least(usable.filter("label = 1").select("doc_id"), most))], 0.5 if share is None else float(share)


def unlabelled_sample(docs: DataFrame, most: int) -> list[str]:
    ids = docs.filter(F.col("doc_id").isNotNull() & (remainder("doc_id", HELD_OUT) != 0)).select("doc_id").distinct()
    return [r["text"] for r in _texts(docs, _least(ids, most))]
