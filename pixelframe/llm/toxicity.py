"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is logistic in the words
and character n-grams of its words; a document is toxic if any of its sentences
is, so its score is the noisy-or of theirs.  Only document labels are known:
the gradient of the document's likelihood tells each sentence how much it
answers for.  The trained model then scores every sentence and locates the
offending ones.

Fitting reads a sample of at most SAMPLE_ROWS labelled rows on the driver;
scoring streams over all documents, one text at a time, without a shuffle.

Defined results: null and empty texts are one empty sentence; without labelled
rows of both kinds every document scores the prior; repeated rows are scored
each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered, give_back, mapped, slices, table, text_of
from .labelled import held_out, labelled_sample

SAMPLE_ROWS = 4000
BUCKETS = 1 << 20
LEAN = 3.0
LEAST_DOCS = 4
STEPS = 120
RATE = 0.15
DECAY = 2e-3
GRAMS = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORD = re.compile(r"\w+")
REMEMBERED = 200_000


def features(word: str) -> set[int]:
    """Buckets of the word itself and of the n-grams of the word with its borders marked."""
    marked = f"^{word}$".encode("utf-8", "surrogatepass")
    grams = {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return {zlib.crc32(x) & (BUCKETS - 1) for x in grams | {marked}}


@dataclass
class SentenceModel:
    weights: np.ndarray  # by bucket
    bias: float
    #: added to the log-odds of a document, for the share of toxic rows in the sample
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            value = self.known[word] = float(self.weights[list(features(word))].sum())
        return value

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, log-odds) of each sentence."""
        out = []
        for m in SENTENCE.finditer(text):
            out.append((m.start(), m.end(), self.bias + sum(map(self.word, set(WORD.findall(m[0].lower()))))))
        return out or [(0, len(text), self.bias)]

    def score(self, odds: np.ndarray) -> float:
        """Noisy-or over the sentences' log-odds, then the shift."""
        none = -np.logaddexp(0, odds).sum()
        some = np.log(-np.expm1(min(none, -1e-300)))
        return float(1 / (1 + np.exp(-np.clip(some - none + self.shift, -500, 500))))


@dataclass
class Bags:
    """The sample as index arrays: which words each sentence has, and whose sentence it is."""

    sentence_of: np.ndarray
    word_of: np.ndarray
    doc_of: np.ndarray
    words: list[str]

    @classmethod
    def of(cls, texts: list[str]) -> Bags:
        ids: dict[str, int] = {}
        sentence_of, word_of, doc_of = array("i"), array("i"), array("i")
        for d, text in enumerate(texts):
            for m in SENTENCE.finditer(text):
                for w in set(WORD.findall(m[0].lower())):
                    sentence_of.append(len(doc_of))
                    word_of.append(ids.setdefault(w, len(ids)))
                doc_of.append(d)
        return cls(*(np.array(x, np.int32) for x in (sentence_of, word_of, doc_of)), list(ids))


def telling(bags: Bags, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) pairs of the features that lean to toxic documents; without the others the fit is small."""
    words = len(bags.words)
    in_doc = np.unique(bags.doc_of[bags.sentence_of].astype(np.int64) * words + bags.word_of)
    docs, toxic = np.bincount(in_doc % words, minlength=words), np.bincount(in_doc % words, weights=y[in_doc // words], minlength=words)
    pair_word, pair_bucket = array("i"), array("i")
    for k, w in enumerate(bags.words):
        found = features(w)
        pair_word.extend([k] * len(found))
        pair_bucket.extend(found)
    pair_word, pair_bucket = np.array(pair_word, np.int32), np.array(pair_bucket, np.int32)
    total = np.bincount(pair_bucket, weights=docs[pair_word], minlength=BUCKETS)
    bad = np.bincount(pair_bucket, weights=toxic[pair_word], minlength=BUCKETS)
    lean = (bad - total * y.mean()) / np.sqrt(total * y.mean() * (1 - y.mean()) + 1)
    keep = ((total >= LEAST_DOCS) & (lean > LEAN))[pair_bucket]
    return pair_word[keep], pair_bucket[keep]


def _log_odds(x: float) -> float:
    x = min(max(x, 1e-4), 1 - 1e-4)
    return float(np.log(x / (1 - x)))


def train(texts: list[str], labels: list[int], share: float | None = None, steps: int = STEPS) -> SentenceModel:
    """Fits sentence weights to document labels; share: of toxic rows where the model is used."""
    y = np.array(labels, dtype=float)
    bags = Bags.of(texts)
    if not len(bags.words) or y.min() == y.max():
        return SentenceModel(np.zeros(BUCKETS), _log_odds(0.5 if share is None else share))
    pair_word, pair_bucket = telling(bags, y)
    buckets, pair_feature = np.unique(pair_bucket, return_inverse=True)
    size, words, sentences, n = len(buckets), len(bags.words), len(bags.doc_of), len(texts)
    used = np.zeros(words, bool)
    used[pair_word] = True
    keep = used[bags.word_of]
    sentence_of, word_of, doc_of = bags.sentence_of[keep], bags.word_of[keep], bags.doc_of
    theta, bias = np.zeros(size), -7.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        value = np.bincount(pair_word, weights=theta[pair_feature], minlength=words)
        odds = bias + np.bincount(sentence_of, weights=value[word_of], minlength=sentences)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        none = np.bincount(doc_of, weights=-np.logaddexp(0, odds), minlength=n)
        some = -np.expm1(np.minimum(none, -1e-12))
        pull = np.where(y == 1, (1 - some) / some, -1.0)  # of the document, on each sentence in proportion to p
        g = p * pull[doc_of] / n
        by_word = np.bincount(word_of, weights=g[sentence_of], minlength=words)
        grad = np.append(np.bincount(pair_feature, weights=by_word[pair_word], minlength=size) - DECAY / n * theta, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta, bias = np.maximum(theta + move[:-1], 0), bias + move[-1]  # evidence adds up; nothing speaks against it
    weights = np.zeros(BUCKETS)
    weights[buckets] = theta
    return SentenceModel(weights, float(bias), 0.0 if share is None else _log_odds(share) - _log_odds(float(y.mean())))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> SentenceModel:
    texts, y, share = labelled_sample(docs, labels, "toxic", most)
    model = train(texts, y, share)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """Per document: score, predicted, and the offending sentences as (begin, end, score), the worst one's text too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for rows in slices(batches):
            scores, found, worst = [], [], []
            for text in rows.column(1).to_pylist():
                parts = fitted.sentences(text)
                odds = np.array([x[2] for x in parts])
                scores.append(fitted.score(odds))
                found.append([{"begin": a, "end": b, "score": float(1 / (1 + np.exp(-z)))} for a, b, z in parts if z >= 0])
                k = int(odds.argmax())
                worst.append(text[parts[k][0] : parts[k][1]] if odds[k] >= 0 else None)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64()), pa.array(found, spans), pa.array(worst, pa.string())], ["doc_id", "score", "offending", "worst_sentence"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).transform(
        mapped,
        run, "doc_id long, score double, offending array<struct<begin:long,end:long,score:double>>, worst_sentence string"
    )
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending", "worst_sentence")


def clean(docs: DataFrame, model: SentenceModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, in place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        fitted = shared.value
        return lambda texts: [fitted.score(np.array([x[2] for x in fitted.sentences(t)])) < threshold for t in texts]

    return filtered(docs, judge)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"), "worst_sentence")
