"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage of n characters that occurs in a text with at most k edits shares at
least n + 1 - q (k + 1) of its q-grams with it, and all of those lie on
diagonals (place in the text less place in the passage) at most k apart from
the one on which the passage begins.  So:

1. texts and passages are lower-cased and their white space made one space;
2. shared q-grams of a text with all passages are looked up in a sorted table;
3. hits are counted by passage in diagonal bands of 4 k + 2 diagonals that
   overlap by half, so that the 2 k + 1 diagonals of any occurrence lie whole in one band;
4. bands that meet the lemma's bound are aligned within their diagonals, with
   free ends in the text, and kept if the edits are at most k.

Each text is handled by itself in one pass without a shuffle.  Passages are a
stated query set: they go to the workers in blocks of at most BLOCK_CHARS
characters, one pass for each block, so what is broadcast has a fixed bound.

Defined results: null texts match nothing, null and empty passages match
nothing; passages under 2 Q = 16 characters, which leave the lemma no bound, are
searched as they are wherever they begin and end between words; repeated passages and
rows all report; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered, mapped, slices, table, text_of

Q = 8
EDIT_RATE = 0.08
BLOCK_CHARS = 4 << 20
FILTER_BITS = 22
SCHEMA = "doc_id long, item_id long, begin long, end long, edits long, item_chars long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(points: np.ndarray) -> np.ndarray:
    """A number for each q-gram: its code points folded to bytes. Equal q-grams have equal numbers; the rare others are told apart by alignment."""
    folded = ((points ^ (points >> 8) ^ (points >> 16)) & 0xFF).astype(np.uint8)
    padded = folded.tobytes() + bytes(8)
    out = np.empty(max(len(folded) - Q + 1, 0), "<u8")
    for k in range(min(8, len(out))):
        out[k::8] = np.frombuffer(padded, "<u8", count=(len(out) - k + 7) // 8, offset=k)
    return out


def _bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def edit_budget(n: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for n characters: no more than leave the lemma a bound of one q-gram."""
    return min(int(rate * n), (n - Q) // Q) if n >= 2 * Q else 0


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(begin, end, edits) of the best occurrence among diagonals low..high, if its edits are at most budget.

    Semi-global edit distance over the band: row i holds the cells of text
    place i + d for each diagonal d.
    """
    n, width, far = len(passage), high - low + 1, 1 << 30
    diagonals = np.arange(low, high + 1)
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    begin = diagonals.copy()
    steps = np.arange(width)
    for i in range(1, n + 1):
        at = i + diagonals  # text characters used at this row
        inside = (at >= 1) & (at <= len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside] - 1] == passage[i - 1]
        straight = np.where(inside, cost + ~same, far)
        skip = np.append(cost[1:] + 1, far)  # the passage has a character more
        skip_begin = np.append(begin[1:], 0)
        skip[(at < 0) | (at > len(text))] = far
        take = skip < straight
        now, start = np.where(take, skip, straight), np.where(take, skip_begin, begin)
        # the text has characters more: least of what is left of it, plus the distance
        lifted = now - steps
        best = np.minimum.accumulate(lifted)
        first = np.maximum.accumulate(np.where(lifted == best, steps, 0))
        extended = np.where(inside, best + steps, far)
        use = extended < now
        cost, begin = np.where(use, extended, now), np.where(use, start[first], start)
        if cost.min() > budget:
            return None
    k = int(np.lexsort((np.abs(diagonals - begin), cost))[0])
    return (int(begin[k]), int(n + diagonals[k]), int(cost[k])) if cost[k] <= budget else None


class Matcher:
    """Finds the passages of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        self.ids = [i for i, _ in items]
        self.texts = [normal(t) for _, t in items]
        self.points = [_points(t) for t in self.texts]
        self.sizes = np.array([len(p) for p in self.points], dtype=np.int64)
        self.budgets = np.array([edit_budget(int(n), rate) for n in self.sizes], dtype=np.int64)
        self.least = self.sizes + 1 - Q * (self.budgets + 1)
        self.short = [k for k, n in enumerate(self.sizes) if 0 < n < 2 * Q]
        self.whole = {k: re.compile(rf"(?<!\w){re.escape(self.texts[k])}(?!\w)") for k in self.short}
        long = [k for k, n in enumerate(self.sizes) if n >= 2 * Q]
        grams = [_grams(self.points[k]) for k in long]
        keys = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        owner = np.repeat(np.array(long, np.int64), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.ends = np.append(self.first[1:], len(keys))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[_bucket(self.keys)] = True
        self.window = int(self.sizes[long].min()) if long else 0
        #: least share of hits among the places of an occurrence
        self.density = min((self.least[k] / (self.sizes[k] + self.budgets[k]) for k in long), default=1.0)
        self.reach = int((self.sizes + 2 * self.budgets).max()) if len(items) else 0

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Places of a text's q-grams that some passage has, in stretches dense enough for an occurrence."""
        hits = np.flatnonzero(self.filter[_bucket(grams)])
        if not len(hits):
            return hits
        # an occurrence of the least density has a stretch of half the window with at least half of that density
        span = max(self.window // 2, 1)
        need = max(int(self.density * span / 2), 1)
        if len(hits) < need:
            return hits[:0]
        tight = hits[need - 1 :] - hits[: len(hits) - need + 1] < span
        if not tight.any():
            return hits[:0]
        marks = np.zeros(len(hits) + 1, np.int64)
        starts = hits[: len(tight)][tight]
        np.add.at(marks, np.searchsorted(hits, starts - self.reach), 1)
        np.add.at(marks, np.searchsorted(hits, starts + span + self.reach, side="right"), -1)
        return hits[np.cumsum(marks[:-1]) > 0]

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, begin, end, edits, item_chars), places in the normalised text."""
        text = normal(text)
        out = []
        for k in self.short:
            for found in self.whole[k].finditer(text):
                out.append((self.ids[k], found.start(), found.end(), 0, int(self.sizes[k])))
        if not self.window or len(text) < Q:
            return out
        points = _points(text)
        grams = _grams(points)
        at = self.places(grams)
        if not len(at):
            return out
        key = np.searchsorted(self.keys, grams[at])
        key[key == len(self.keys)] = 0
        real = self.keys[key] == grams[at]
        at, key = at[real], key[real]
        copies = self.ends[key] - self.first[key]
        total = int(copies.sum())
        if not total:
            return out
        entry = np.repeat(self.first[key] - np.concatenate(([0], np.cumsum(copies)[:-1])), copies) + np.arange(total)
        item, place = self.owner[entry], self.place[entry]
        diagonal = np.repeat(at, copies) - place
        step = 2 * self.budgets[item] + 1
        band = diagonal // step
        # a hit counts for its own half band and the one before: bands are [b * step, (b + 2) * step)
        bands = np.concatenate((band, band - 1))
        lowest = int(bands.min())
        span = int(bands.max()) - lowest + 1
        code = (np.concatenate((item, item)) * span + bands - lowest) * (int(self.sizes.max()) + 1) + np.concatenate((place, place))
        found, counts = np.unique(np.unique(code) // (int(self.sizes.max()) + 1), return_counts=True)  # distinct q-grams of the passage
        items, bands = found // span, found % span + lowest
        enough = counts >= self.least[items]
        best: dict[int, list[tuple[int, int, int]]] = {}
        for k, b in zip(items[enough].tolist(), bands[enough].tolist()):
            budget = int(self.budgets[k])
            low, high = b * (2 * budget + 1), (b + 2) * (2 * budget + 1) - 1
            exact = text.find(self.texts[k], max(low, 0), max(high + int(self.sizes[k]), 0))  # the alignment without edits
            hit = (exact, exact + int(self.sizes[k]), 0) if exact >= 0 else align(self.points[k], points, low - budget, high + budget, budget)
            if hit is not None:
                best.setdefault(k, []).append(hit)
        for k, hits in best.items():
            taken: list[tuple[int, int, int]] = []
            for hit in sorted(set(hits), key=lambda h: (h[2], h[0])):  # neighbouring bands see the same occurrence
                if all(hit[1] <= x[0] or hit[0] >= x[1] for x in taken):
                    taken.append(hit)
            out += [(self.ids[k], begin, end, edits, int(self.sizes[k])) for begin, end, edits in taken]
        return sorted(out)


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of bounded size."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("long"), text_of(text_col)).filter(F.col(id_col).isNotNull()).orderBy(id_col).toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, most: int = BLOCK_CHARS) -> DataFrame:
    """One row for each occurrence of a passage in a document; begin and end count characters of the normalised text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    kinds = (pa.int64(),) * 6
    names = ["doc_id", "item_id", "begin", "end", "edits", "item_chars"]

    def one(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        fitted: list[Matcher] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not fitted:
                fitted.append(Matcher(shared.value, rate))
            for rows in slices(batches):
                found = [(doc, *hit) for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()) for hit in fitted[0].find(text)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names)

        return mapped(rows, run, SCHEMA)

    parts = [one(block) for block in blocks(items, "item_id", "text", most)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def uncontaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, most: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in which no passage occurs, in place."""
    for block in blocks(items, "item_id", "text", most):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def judge(shared=shared):
            fitted = Matcher(shared.value, rate)
            return lambda texts: [not fitted.find(t) for t in texts]

        docs = filtered(docs, judge)
    return docs


def op2_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
