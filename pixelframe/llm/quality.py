"""Text quality by positive-unlabelled learning.

Trusted positives are rows labelled good; the other side is unlabelled web
text, which holds good rows too.  With the share of good rows as class prior
the risk over negatives is estimated as the unlabelled risk less the prior
times the positives' share of it; that estimate is kept from going below zero
(the non-negative unbiased risk).  The model is linear over measures of a
text's shape, each cut into steps at quantiles of all training documents.

Quantiles come from counts of each measure's values, to a 512th of a power of
two, over all training documents; the counts are few at any size.  Fitting
reads at most SAMPLE_ROWS positives and as many unlabelled rows on the driver; labels other than those of positives are used for the prior only.
Scoring streams over all documents without a shuffle.

Defined results: null and empty texts have the measures of the empty text;
without positives or text every document scores the prior; repeated rows are
scored each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, mapped, remainder, slices, table, text_of
from .labelled import HELD_OUT, held_out, positive_sample, unlabelled_sample

SAMPLE_ROWS = 4000
STEPS = 24
EPOCHS = 400
RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.3
CELL = 43  # low bits of a value that its count leaves out
FLUSH = 200_000
# half of the cuts from each side: rare shapes are found in the unlabelled tail
QUANTILES = np.sort(np.concatenate((np.linspace(0, 1, STEPS // 2, endpoint=False)[1:], [0.99, 0.998, 1e-3, 0.01, 0.03])))

_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 192),  # letters: a-z and lead bytes of others
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 48) & (_BYTES <= 57),
        np.isin(_BYTES, list(b" \t\r\x0b\x0c")),
        _BYTES == 10,
        np.isin(_BYTES, list(b".,;:'\"()-")),
        np.isin(_BYTES, list(b"!?")),
        np.isin(_BYTES, list(b"#$%&*@^~+=<>[]{}|\\/_`")),
        _BYTES == 124,
        (_BYTES < 32) & ~np.isin(_BYTES, list(b"\t\n\r\x0b\x0c")),
    ]
).astype(float)


def measures(text: str) -> np.ndarray:
    """What a text looks like: shares of character classes, lengths, repetition."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = _CLASSES @ counts
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n, size = max(len(words), 1), max(len(raw), 1)
    distinct = len(set(words))
    sentences = max(by_class[5] + by_class[6], 1)
    return np.concatenate(
        (
            by_class / size,
            [
                by_class[7] / n,
                by_class[6] / n,
                np.log1p(len(words)),
                size / n,
                distinct / n,
                np.log(distinct + 1) / np.log(n + 1),
                sum(map(eq, words, words[1:])) / n,
                len(set(lines)) / max(len(lines), 1),
                len(words) / max(len(lines), 1),
                n / sentences,
                by_class[1] / max(by_class[0] + by_class[1], 1),
                float(counts.max()) / size,
                max(map(len, words), default=0),
            ],
        )
    )


@dataclass
class QualityModel:
    cuts: np.ndarray  # measures x steps
    weights: np.ndarray  # measures x (steps + 1)
    bias: float

    def bins(self, values: np.ndarray) -> np.ndarray:
        """The step of each measure, as columns of the flat weights."""
        steps = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, values.T)], axis=1) if len(values) else np.empty((0, len(self.cuts)), int)
        return steps + np.arange(len(self.cuts)) * (self.cuts.shape[1] + 1)

    def score(self, values: np.ndarray) -> np.ndarray:
        odds = self.bias + self.weights.ravel()[self.bins(values)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def corpus_cuts(docs: DataFrame) -> np.ndarray | None:
    """The measures' QUANTILES over all documents that may be learnt from; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["cell", "n"])
            counts.clear()
            return out

        for rows in slices(batches):
            values = np.array([measures(x) for x in rows.column(0).to_pylist()])
            # values are not negative, so their bits are in order
            cells, n = np.unique((values.view(np.int64) >> CELL) + (np.arange(values.shape[1]) << 63 - CELL), return_counts=True)
            for cell, k in zip(cells.tolist(), n.tolist()):
                counts[cell] += k
            if len(counts) > FLUSH:
                yield flush()
        if counts:
            yield flush()

    learnt = docs.filter(F.col("doc_id").isNotNull() & (remainder("doc_id", HELD_OUT) != 0)).select(text_of().alias("text"))
    found = learnt.transform(mapped, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    cells, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(cells)
    cells, n = cells[order], n[order]
    of, cuts = cells >> 63 - CELL, []
    for k in range(int(of[-1]) + 1):
        mine, total = cells[of == k] - (k << 63 - CELL), np.cumsum(n[of == k])
        at = mine[np.minimum(np.searchsorted(total, QUANTILES * total[-1]), len(mine) - 1)]
        cuts.append(((at + 1 << CELL) - 1).view(np.float64))  # the largest value of the cell
    return np.stack(cuts)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, cuts: np.ndarray | None = None) -> QualityModel:
    """Minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), logistic loss."""
    width = len(measures(""))
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    empty = QualityModel(np.zeros((width, STEPS)), np.zeros((width, STEPS + 1)), float(np.log(prior / (1 - prior))))
    if not len(positive) or not len(unlabelled):
        return empty
    if cuts is None:
        cuts = np.sort(np.quantile(unlabelled, QUANTILES, axis=0).T, axis=1)
    cuts = np.concatenate((cuts, np.repeat(cuts[:, -1:], STEPS - cuts.shape[1], axis=1)), axis=1)
    model = QualityModel(cuts, np.zeros((width, STEPS + 1)), empty.bias)
    p, u = model.bins(positive), model.bins(unlabelled)
    size = width * (STEPS + 1)
    theta, bias = np.zeros(size), empty.bias
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    gather = lambda rows, g: np.append(np.bincount(rows.ravel(), weights=np.repeat(g, width), minlength=size), g.sum())
    for step in range(1, epochs + 1):
        fp, fu = bias + theta[p].sum(axis=1), bias + theta[u].sum(axis=1)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up = gather(p, prior * (sp - 1) / len(p))
        down = gather(u, su / len(u)) - gather(p, prior * sp / len(p))
        # below zero the estimate has overfitted: step back along it instead
        grad = up + down if negative >= 0 else -down
        grad[:-1] += DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    model.weights, model.bias = theta.reshape(width, STEPS + 1), float(bias)
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> QualityModel:
    good, prior = positive_sample(docs, labels, "quality", most)
    shapes = lambda texts: np.array([measures(x) for x in texts]).reshape(len(texts), len(measures("")))
    positive = shapes(good)
    del good
    model = train(positive, shapes(unlabelled_sample(docs, most)), prior, cuts=corpus_cuts(docs))
    give_back()
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for rows in slices(batches):
            values = np.array([measures(x) for x in rows.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fitted.score(values))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).transform(mapped, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
