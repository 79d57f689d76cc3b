"""Registered queries against their SQL twins at the smallest scale."""

import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from pixelframe.plans import registry

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


def _rows(rows):
    return sorted(tuple((x is None, round(x, 9) if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(ours.columns)
    assert _rows(ours.select(*names).collect()) == _rows(found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_registry_is_whole():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name,epochs,patience", [("softmax_train", 50, 15), ("cnn_train", 15, 5)])
def test_training_is_as_long_as_the_reference(spark, monkeypatch, name, epochs, patience):
    seen = {}

    def fit(net, train, val, optimizer, patience=15, **settings):
        seen.update(settings, patience=patience, rows=train.count(), net=net)
        raise StopIteration

    monkeypatch.setattr(registry.models, "fit", fit)
    with pytest.raises(StopIteration):
        registry.QUERIES[name](spark, SF)
    assert seen["epochs"] == epochs and seen["patience"] == patience and 24 <= seen["rows"] / seen["batches"] <= 32
    assert name == "softmax_train" or len(seen["net"].weights["K"]) == 8


def test_softmax_training_takes_few_jobs(spark):
    spark.sparkContext.setJobGroup("softmax", "softmax")
    log = registry.QUERIES["softmax_train"](spark, SF).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("softmax"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    train, _ = registry.train_test(spark, SF)
    assert jobs < len(log) * registry._minibatches(train) / 2
    assert [r["epoch"] for r in sorted(log)] == list(range(1, len(log) + 1)) and min(r["train_loss"] for r in log) < log[0]["train_loss"]


def test_softmax_training_needs_no_job_an_epoch(spark, monkeypatch):
    """Epochs over several blocks are one job, and come out alike where each is a job of its own."""
    monkeypatch.setattr(registry.models, "BLOCK_BYTES", 64 << 10)
    logs, jobs = [], []
    for seconds in (600.0, 0.0):
        monkeypatch.setattr(registry.models, "JOB_SECONDS", seconds, raising=False)
        spark.sparkContext.setJobGroup(f"softmax {seconds}", "softmax")
        logs.append(sorted(registry.QUERIES["softmax_train"](spark, SF).collect()))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"softmax {seconds}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] < len(logs[0]) <= jobs[1]
    assert [r["epoch"] for r in logs[1]] == list(range(1, len(logs[0]) + 1))
    assert all(tuple(a) == pytest.approx(tuple(b)) for a, b in zip(*logs))
