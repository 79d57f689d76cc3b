"""Softmax regression and a small convolutional network.

Weights are small and live on the driver.  Each full-batch step sends them to
the tasks, which return summed gradients, one record for each task.  Minibatches
follow one another, so they are one thread of work and not a job each: rows are
dealt once into blocks of at most about BLOCK_BYTES, and one task keeps the
blocks in a file on its own disk, holds one of them at a time and takes epoch
after epoch.  After JOB_SECONDS it hands weights, optimiser state and log back,
and another task goes on from there.  Stopping follows the epoch's totals.
"""

from __future__ import annotations

import json
import math
import os
import pickle
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import positive
from ..functions.pixels import let
from ..functions.stacks import BATCH_BYTES, LIMIT
from ..ship import ship
from ..sources.scratch import remove, scratch_path

Weights = dict[str, np.ndarray]
#: features of the rows that one task walks, as doubles
BLOCK_BYTES = 16 << 20
#: how long a task takes epochs; what a failure loses
JOB_SECONDS = 600.0
#: minibatches whose losses are summed at once
RUN = 64


class Rule(NamedTuple):
    """How a step moves the weights, all of them one vector: step(state, weights, gradient) gives the next state, for which it may use up the last, and weights."""

    rate: float
    step: Callable


def descent(rate: float = 0.01) -> Rule:
    positive(rate, "rate")
    return Rule(rate, lambda state, w, g: (state, w - rate * g))


def adam(rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8) -> Rule:
    """Bias-corrected moments; the state is the number of steps and both moments."""
    positive(rate, "rate")

    def step(state, w: np.ndarray, g: np.ndarray):
        t, first, second = state or (0, np.zeros(g.shape), np.zeros(g.shape))
        t += 1
        part = (1 - beta1) * g
        first *= beta1
        first += part
        np.multiply(1 - beta2, g, out=part)
        part *= g
        second *= beta2
        second += part
        np.divide(second, 1 - beta2**t, out=part)
        np.sqrt(part, out=part)
        part += eps
        move = rate / (1 - beta1**t) * first
        move /= part
        return (t, first, second), w - move

    return Rule(rate, step)


def flattened(weights: Weights) -> np.ndarray:
    """All weights as one vector, by name."""
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def shaped(flat: np.ndarray, like: Weights) -> Weights:
    """The inverse of flattened, for weights of the names and shapes of like."""
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: part.reshape(like[k].shape) for k, part in zip(sorted(like), np.split(flat, ends[:-1]))}


def stable_softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def softmax_column(scores: str) -> Column:
    """The same on an array column."""
    raised = let(F.array_max(scores), lambda high: F.transform(scores, lambda x: F.exp(x - high)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return let(raised, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def cross_entropy(p: np.ndarray, labels: np.ndarray) -> float:
    """Summed over rows."""
    return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-15)).sum())


class SoftmaxModel:
    """One linear layer; gradients are sums over rows."""

    def __init__(self, n_features: int, classes: int, seed: int = 0):
        self.classes = classes
        self.weights: Weights = {"W": 0.01 * np.random.default_rng(seed).standard_normal((n_features, classes)), "b": np.zeros(classes)}

    def probabilities(self, weights: Weights, x: np.ndarray) -> np.ndarray:
        return stable_softmax(x @ weights["W"] + weights["b"])

    def gradients(self, weights: Weights, x: np.ndarray, labels: np.ndarray) -> tuple[float, int, Weights]:
        p = self.probabilities(weights, x)
        loss, right = cross_entropy(p, labels), int((p.argmax(axis=1) == labels).sum())
        p[np.arange(len(labels)), labels] -= 1
        return loss, right, {"W": x.T @ p, "b": p.sum(axis=0)}

    def steps(self, flat: np.ndarray, state, x: np.ndarray, labels: np.ndarray, size: int, step: Callable) -> tuple[object, float, int]:
        """What _steps does in fewer and larger calls: rows are columns, the bias is the weight of a feature that is 1."""
        w, loss, right = flat.reshape(-1, self.classes).T, 0.0, 0  # b follows W by name
        for low in range(0, len(labels), RUN * size):
            true = labels[low : low + RUN * size]
            rows = np.concatenate((x[low : low + len(true)], np.ones((len(true), 1))), axis=1)
            sure, p = np.zeros((self.classes, len(true))), np.empty((self.classes, len(true)))
            sure[true, np.arange(len(true))] = 1
            for at in range(0, len(true), size):
                mine = slice(at, min(at + size, len(true)))
                z = w @ rows[mine].T
                z -= np.maximum.reduce(z, axis=0)
                np.exp(z, out=z)
                np.divide(z, np.add.reduce(z, axis=0), out=p[:, mine])
                np.subtract(p[:, mine], sure[:, mine], out=z)
                state, flat[:] = step(state, flat, (rows[mine].T @ z.T).ravel(), mine.stop - at)
            loss, right = loss + cross_entropy(p.T, true), right + int((p.argmax(axis=0) == true).sum())
        return state, loss, right


class ConvModel:
    """Convolution (3x3, border 1), ReLU, 2x2 max-pooling and a dense layer on gray square images."""

    def __init__(self, side: int, filters: int, classes: int, seed: int = 0):
        random = np.random.default_rng(seed)
        self.side, self.classes = side, classes
        flat = (side // 2) ** 2 * filters
        self.weights: Weights = {
            "K": random.standard_normal((filters, 9)) * np.sqrt(2 / 9),
            "k": np.zeros(filters),
            "W": random.standard_normal((flat, classes)) * np.sqrt(2 / flat),
            "b": np.zeros(classes),
        }

    def _forward(self, weights: Weights, x: np.ndarray):
        n, s, h = len(x), self.side, self.side // 2
        image = np.zeros((n, s + 2, s + 2))
        image[:, 1:-1, 1:-1] = x.reshape(n, s, s)
        windows = np.lib.stride_tricks.sliding_window_view(image, (3, 3), axis=(1, 2)).reshape(n, s, s, 9)
        active = np.maximum(windows @ weights["K"].T + weights["k"], 0)
        cells = active[:, : 2 * h, : 2 * h].reshape(n, h, 2, h, 2, -1)
        rows = np.maximum(cells[:, :, 0], cells[:, :, 1])
        pooled = np.maximum(rows[:, :, :, 0], rows[:, :, :, 1])
        flat = pooled.reshape(n, -1)
        return windows, active, cells, pooled, flat, stable_softmax(flat @ weights["W"] + weights["b"])

    def probabilities(self, weights: Weights, x: np.ndarray) -> np.ndarray:
        return self._forward(weights, x)[-1]

    def gradients(self, weights: Weights, x: np.ndarray, labels: np.ndarray) -> tuple[float, int, Weights]:
        windows, active, cells, pooled, flat, p = self._forward(weights, x)
        loss, right = cross_entropy(p, labels), int((p.argmax(axis=1) == labels).sum())
        d = p.copy()
        d[np.arange(len(labels)), labels] -= 1
        back = (d @ weights["W"].T).reshape(pooled.shape)[:, :, None, :, None, :] * (cells == pooled[:, :, None, :, None, :])  # all tied maxima
        h = self.side // 2
        full = np.zeros_like(active)
        full[:, : 2 * h, : 2 * h] = back.reshape(len(x), 2 * h, 2 * h, -1)
        full *= active > 0
        return loss, right, {"K": np.tensordot(full, windows, axes=([0, 1, 2], [0, 1, 2])), "k": full.sum(axis=(0, 1, 2)), "W": flat.T @ d, "b": d.sum(axis=0)}


def _matrix(rows: pa.RecordBatch, column: int) -> np.ndarray:
    values = rows.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)


CHUNK = "labels binary, features binary"


def _stored(chunk: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The features, as they are stored, and labels of a CHUNK."""
    labels = np.frombuffer(chunk["labels"], np.int32)
    kind = np.float32 if len(chunk["features"]) < 8 * width * len(labels) else np.float64
    return np.frombuffer(chunk["features"], kind).reshape(-1, width), labels


def _numbers(chunk: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of a CHUNK."""
    x, labels = _stored(chunk, width)
    return x.astype(float, copy=False), labels


def _chunk(rows: pa.RecordBatch | pa.Table, order: np.ndarray | slice = slice(None)) -> list[bytes]:
    """Labels and features of rows (label, features) as a CHUNK's bytes; features in 4 bytes each where that loses nothing."""
    labels = rows.column("label").to_numpy()
    values = rows.column("features")
    values = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        short = values.astype(np.float32)
    values = short if (short == values).all() else values.astype(float)
    return [x[order].tobytes() for x in (labels.astype(np.int32), values.reshape(len(labels), -1))]


def _typed(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(F.col("label").cast("int").alias("label"), F.col("features").cast("array<double>").alias("features"), *more)


def _stored_chunks(rows: DataFrame) -> str:
    """The path of rows (label, features) as CHUNKs, where they are: epochs read numbers and not columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _chunk(batch)], ["labels", "features"])

    path = scratch_path(rows.sparkSession, "training-rows")
    _typed(rows).mapInArrow(run, CHUNK).write.parquet(path)
    return path


def _dealt(rows: DataFrame) -> Column:
    """A hash that tells rows with equal features apart where they have ids."""
    return F.xxhash64(*[c for c in ("id", "label", "features") if c in rows.columns])


def _stored_blocks(rows: DataFrame, blocks: int) -> str:
    """The path of rows dealt at random into blocks, one CHUNK each."""

    def run(found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("order").to_numpy(), kind="stable")
        return pa.table({"block": [found.column("block")[0]]} | {k: pa.array([x], pa.binary()) for k, x in zip(("labels", "features"), _chunk(found, order))}, pa.schema([("block", pa.int32()), ("labels", pa.binary()), ("features", pa.binary())]))

    path = scratch_path(rows.sparkSession, "training-blocks")
    key = _dealt(rows)
    dealt = _typed(rows, F.pmod(key, F.lit(blocks)).cast("int").alias("block"), F.xxhash64(key).alias("order"))
    dealt.groupBy("block").applyInArrow(run, f"block int, {CHUNK}").write.partitionBy("block").parquet(path)
    return path


def _totals(spark: SparkSession, path: str, width: int, model, weights: Weights, with_gradient: bool) -> tuple[int, float, int, np.ndarray]:
    """Row count, loss, right answers and the gradient's sum over the stored CHUNKs, as one vector."""
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, right, total = 0, 0.0, 0, None
        for batch in batches:
            for chunk in batch.to_pylist():
                x, labels = _numbers(chunk, width)
                a, b, g = model.gradients(shared.value, x, labels)
                flat = flattened(g) if with_gradient else np.empty(0)
                n, loss, right, total = n + len(labels), loss + a, right + b, flat if total is None else total + flat
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([right]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "loss", "right", "g"])

    n, loss, right, total = 0, 0.0, 0, np.zeros(0)
    for r in spark.read.schema(CHUNK).parquet(path).mapInArrow(run, "n long, loss double, right long, g array<double>").collect():  # one record for each task
        n, loss, right, total = n + r["n"], loss + r["loss"], right + r["right"], np.array(r["g"]) + (total if len(total) else 0)
    shared.unpersist()
    return n, loss, right, total


def _moved(rule: Rule, state, w: np.ndarray, g: np.ndarray, n: int, decay: np.ndarray, clip: float | None):
    """State and weights after a step along the summed gradient of n rows, which is used up."""
    g /= n
    g += decay * w
    if clip:
        np.minimum(g, clip, out=g)
        np.maximum(g, -clip, out=g)
    return rule.step(state, w, g)


def _steps(model, first: Weights, flat: np.ndarray, state, x: np.ndarray, labels: np.ndarray, size: int, step: Callable) -> tuple[object, float, int]:
    """The state, loss and right answers of minibatches of `size` rows, one step each, which change flat."""
    if hasattr(model, "steps"):
        return model.steps(flat, state, x, labels, size, step)
    weights, loss, right = shaped(flat, first), 0.0, 0  # views: they follow flat
    for at in range(0, len(labels), size):
        mine = slice(at, min(at + size, len(labels)))
        a, b, g = model.gradients(weights, x[mine], labels[mine])
        state, flat[:] = step(state, flat, flattened(g), mine.stop - at)
        loss, right = loss + a, right + b
    return state, loss, right


class Shelf:
    """CHUNKs by block in a nameless file on the disk of this worker, which goes when it is closed."""

    def __init__(self):
        self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.places: dict[int, list[tuple[int, int, int]]] = {}

    def put(self, chunk: dict) -> None:
        place = (self.file.seek(0, os.SEEK_END), len(chunk["labels"]), len(chunk["features"]))
        self.places.setdefault(chunk["block"], []).append(place)
        self.file.write(chunk["labels"])
        self.file.write(chunk["features"])

    def chunks(self, block: int) -> Iterator[dict]:
        for at, labels, features in self.places.get(block, []):
            self.file.seek(at)
            yield {"labels": self.file.read(labels), "features": self.file.read(features)}


@dataclass
class Course:
    """Where a training stands after an epoch."""

    w: np.ndarray
    best: np.ndarray
    state: object = None
    best_loss: float = np.inf
    waited: int = 0
    stopped: bool = False
    log: list[tuple] = field(default_factory=list)

    def note(self, trained: tuple[int, float, int], tested: tuple[int, float, int], penalty: float, rate: float, patience: int) -> None:
        """Logs an epoch by its rows, loss and right answers, and stops when the validation loss has not fallen for `patience` epochs."""
        (n, loss, right), (m, val_loss, val_right) = trained, tested
        val_loss = val_loss / max(m, 1) + penalty
        self.log.append((len(self.log) + 1, loss / max(n, 1) + penalty, val_loss, right / max(n, 1), val_right / max(m, 1), rate))
        if val_loss < self.best_loss:
            self.best, self.best_loss, self.waited = self.w, val_loss, 0
        else:
            self.waited += 1
            self.stopped = self.waited >= patience


#: the block of the validation rows
VALIDATION = -1


def _epoch(shelf: Shelf, width: int, model, first: Weights, course: Course, size: int, step: Callable) -> tuple[int, float, int]:
    """Rows, loss and right answers of an epoch over the blocks of a shelf; rows that fill no minibatch go before the next block."""
    blocks, epoch = sorted(set(shelf.places) - {VALIDATION}), len(course.log) + 1
    order = np.random.default_rng(epoch).permutation(len(blocks)).tolist()
    flat, state, seen, loss, right = course.w.copy(), course.state, 0, 0.0, 0
    over_x, over_labels = np.empty((0, width)), np.empty(0, np.int32)
    for k in order:
        (chunk,) = shelf.chunks(blocks[k])
        raw, labels = _stored(chunk, width)
        mixed, over = np.random.default_rng((epoch, k)).permutation(len(labels)), len(over_labels)
        x, labels = np.empty((over + len(mixed), width)), np.concatenate((over_labels, labels[mixed]))
        x[:over], x[over:] = over_x, raw[mixed]
        end = len(labels) if k == order[-1] else len(labels) // size * size
        state, a, b = _steps(model, first, flat, state, x[:end], labels[:end], size, step)
        seen, loss, right = seen + end, loss + a, right + b
        over_x, over_labels = x[end:].copy(), labels[end:].copy()
    course.w, course.state = flat, state
    return seen, loss, right


def _validated(shelf: Shelf, width: int, model, weights: Weights) -> tuple[int, float, int]:
    n, losses, right = 0, [], 0
    for chunk in shelf.chunks(VALIDATION):
        x, labels = _numbers(chunk, width)
        loss, b, _ = model.gradients(weights, x, labels)
        n, right = n + len(labels), right + b
        losses.append(loss)
    return n, math.fsum(losses), right  # in any order of chunks


def _walked(spark: SparkSession, blocks: str, val: str, width: int, model, first: Weights, course: Course, size: int, epochs: int, step: Callable, note: Callable) -> Course:
    """The course after as many epochs over stored blocks as a task takes in JOB_SECONDS, at least one."""
    most = JOB_SECONDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, now = Shelf(), course
        with shelf.file:
            for batch in batches:
                for k in range(batch.num_rows):
                    shelf.put(batch.slice(k, 1).to_pylist()[0])
            began = time.monotonic()
            while True:
                trained = _epoch(shelf, width, model, first, now, size, step)
                note(now, trained, _validated(shelf, width, model, shaped(now.w, first)))
                if now.stopped or len(now.log) >= epochs or time.monotonic() - began >= most:
                    break
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(now)], pa.binary())], ["course"])

    typed = f"block int, {CHUNK}"
    chunks = spark.read.schema(CHUNK).parquet(val).select(F.lit(VALIDATION).alias("block"), "labels", "features")
    both = spark.read.schema(typed).parquet(blocks).select("block", "labels", "features").union(chunks)
    (row,) = both.coalesce(1).mapInArrow(run, "course binary").collect()
    return pickle.loads(row["course"])


@dataclass
class Training:
    weights: Weights
    log: list[tuple] = field(default_factory=list)


LOG_SCHEMA = "epoch int, train_loss double, val_loss double, train_acc double, val_acc double, learning_rate double"


def fit(model, train: DataFrame, val: DataFrame, rule: Rule, epochs: int = 10, decay: float = 1e-3, clip: float | None = 1.0, patience: int = 15, batches: int = 1) -> Training:
    """Stops when the validation loss has not fallen for `patience` epochs and then takes the best weights back.

    Rows go in `batches` minibatches of one size, the last of which may be
    smaller: rows are dealt into blocks by a hash, and every epoch takes the
    blocks, and the rows of each, in a new random order.  Minibatches beyond a
    block are the remainders of that hash, and their gradients are summed where
    their rows are.
    """
    spark, first = train.sparkSession, model.weights
    ship(spark)
    if LIMIT not in spark.conf.getAll:
        spark.conf.set(LIMIT, BATCH_BYTES)  # where nobody has set one
    rows, width = train.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    width = max(width or 0, 1)
    size = -(-max(rows, 1) // batches)
    paths, whole = [_stored_chunks(val)], batches == 1 or not rows or 8 * width * size > BLOCK_BYTES
    if whole:
        part = F.pmod(_dealt(train), F.lit(batches))
        paths += [_stored_chunks(train.filter(part == k) if batches > 1 else train) for k in range(batches)]
    else:
        paths.append(_stored_blocks(train, -(-8 * width * rows // BLOCK_BYTES)))
    decayed = flattened({k: np.full(x.shape, float(k in ("W", "K"))) for k, x in first.items()})
    pull = decay * decayed
    step = lambda state, w, g, n: _moved(rule, state, w, g, n, pull, clip)
    note = lambda course, trained, tested: course.note(trained, tested, float((pull * course.w * course.w).sum()) / 2, float(rule.rate), patience)
    course = Course(flattened(first), flattened(first))
    try:
        while len(course.log) < epochs and not course.stopped:
            if not whole:
                course = _walked(spark, paths[1], paths[0], width, model, first, course, size, epochs, step, note)
                continue
            seen, loss, right = 0, 0.0, 0
            for path in paths[1:]:
                n, a, b, g = _totals(spark, path, width, model, shaped(course.w, first), True)
                if n:
                    seen, loss, right = seen + n, loss + a, right + b
                    course.state, course.w = step(course.state, course.w, g, n)
            note(course, (seen, loss, right), _totals(spark, paths[0], width, model, shaped(course.w, first), False)[:3])
        return Training(shaped(course.best if course.stopped else course.w, first), course.log)
    finally:
        for path in paths:
            remove(spark, path)


def probabilities(rows: DataFrame, model, weights: Weights) -> DataFrame:
    """(id, p ARRAY): the probability of each class by Arrow batches."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model.probabilities(shared.value, _matrix(batch, 1))
                ends = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(p.ravel()))], ["id", "p"])

    return rows.select(F.col("id").cast("long"), F.col("features").cast("array<double>")).mapInArrow(run, "id long, p array<double>")


def predict(rows: DataFrame, model, weights: Weights) -> DataFrame:
    """(id, y_true, y_pred) by Arrow batches."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = model.probabilities(shared.value, _matrix(batch, 2)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32))], ["id", "y_true", "y_pred"])

    return rows.select(F.col("id").cast("long"), F.col("label").cast("int"), F.col("features").cast("array<double>")).mapInArrow(run, "id long, y_true int, y_pred int")


def save_checkpoint(spark: SparkSession, weights: Weights, epoch: int, path: str) -> None:
    text = json.dumps({"epoch": epoch, "weights": {k: v.tolist() for k, v in weights.items()}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_checkpoint(spark: SparkSession, path: str, initial: Weights, warn: Callable[[str], None] = print) -> tuple[Weights, int]:
    """The saved weights; the initial ones, with a warning, where nothing is saved."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        warn(f"no checkpoint in {path}; the initial weights stay")
        return initial, 0
    found = json.loads(row[0])
    return {k: np.array(v) for k, v in found["weights"].items()}, found["epoch"]


def weight_table(spark: SparkSession, weights: Weights) -> DataFrame:
    """(param, idx, value) of a model, for inspection."""
    rows = [(k, [int(i) for i in idx], float(v)) for k, w in sorted(weights.items()) for idx, v in np.ndenumerate(w)]
    return spark.createDataFrame(rows, "param string, idx array<int>, value double")
