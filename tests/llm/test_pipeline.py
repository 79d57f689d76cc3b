"""The pipeline's decisions on a small set with planted cases."""

import numpy as np

import corpus_pipeline
from pixelframe.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 0 < before <= 200


def test_planted_cases_go(spark):
    r = np.random.default_rng(0)
    prose = lambda: " ".join(f"w{k}" for k in r.integers(0, 900, 120))
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    one, two = prose(), prose()
    texts = [one, one, two, two + " more", prose() + " " + passage + " " + prose(), prose()]
    docs = spark.createDataFrame([(10_000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stored(stage(spark, docs, SF), "test-planted")
    assert sorted(x["doc_id"] - 10_000 for x in docs.collect()) == [1, 2, 5]


def test_odd_tables_pass_every_stage(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, kept int"
    texts = [None, "", "x" * 200_000, "a b c", "a b c", None, "one text", "another text of the same id"]
    ids = [1, 2, 3, 4, 5, None, 7, 7]
    table = spark.createDataFrame([(i, t, "en", "s", None, "d", 0, 0) for i, t in zip(ids, texts)], columns)
    for docs in (table, table.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), "test-odd")
            assert docs.columns == table.columns
        kept = sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in docs.collect())
        if kept:
            # equal texts: the largest id stays; an id with two texts keeps both; null ids stay
            assert ("7", "anoth") in kept and ("7", "one t") in kept and ("None", "") in kept and ("5", "a b c") in kept and ("4", "a b c") not in kept
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.count() >= len(kept)
