"""From raw documents to packed training sequences: a chain of (name, function) stages.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and
reread as the next stage's docs.  All stages but the last return the columns of
documents.  Rows with a null doc_id pass the stages that decide by id; an id
that several texts share stays while one of them does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from pixelframe.llm.common import discard, rejected, stored, table, without

#: chunks of texts that a worker remembers in the last stage
KNOWN_CHUNKS = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below one half; it learns from the labels of the documents at hand."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return without(docs, rejected(exact_dedup.exact_dedup(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return without(docs, rejected(near_dedup.near_dedup(docs)))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    Workers remember fewer chunks than when packing is all they do: executors
    hold what earlier stages have left.
    """
    return packing.packed_documents(docs, known=KNOWN_CHUNKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]

#: trained models, signatures and subword encoding are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
