"""Vector best-fit packing of documents into training sequences.

A bin has three residual capacities: tokens, documents, and attention cost
(the sum of squared lengths).  Pieces are placed longest first; among the open
bins in which every capacity suffices the one with the smallest residual norm
after placing wins, or the one with the smallest weighted dot product of demand
and residual (the fullest where the piece needs most), as `rule` says.

Pieces of one length are alike, so the plan is made over counts by length:
bins of equal state are one record with a number of copies.  The driver sees
at most one count for each length up to the sequence length, however many
documents there are.  Pieces then take their places by rank: the plan lists,
for each length, runs of equal bins; the n-th piece of a length goes to the
bin that the runs give for n.  Ranks come from counts for each input task and
length, so no length, however common, meets in one task.

Defined results: null text is empty and has the end id only; ties in length
are ranked by input order; repeated ids are packed as rows of their own; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, slices, stored, table, text_of
from .encoders import KNOWN, encoder

END_ID = 2
LENGTH = 1024
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and the weights of the three dimensions in the choice of a bin."""

    tokens: int = LENGTH
    documents: int = LENGTH
    cost: int = LENGTH * LENGTH
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"  # or "dot"


@dataclass
class Plan:
    """Runs of places by length: the pieces of rank [begin, begin + count) go to `bins` bins from `first` on, `each` to a bin."""

    runs: dict[int, list[tuple[int, int, int, int]]]
    sequences: int


def pieces_of(n_tokens: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    first = n_tokens if n_tokens <= length else n_tokens % length
    out = [(0, first)] if first else []
    return out + [(at, length) for at in range(first, n_tokens, length)]


def _score(state: tuple[int, int, int], need: tuple[int, int, int], cap: Capacity) -> float:
    size = (cap.tokens, cap.documents, cap.cost)
    if cap.rule == "dot":
        return sum(w * (n / s) * (r / s) for w, n, r, s in zip(cap.weights, need, state, size))
    return sum(w * ((r - n) / s) ** 2 for w, n, r, s in zip(cap.weights, need, state, size))


def _least_score(tokens: int, need: tuple[int, int, int], cap: Capacity) -> float:
    """No bin with so many tokens left in which the piece fits scores less: the other dimensions are taken at their best."""
    return _score((tokens, need[1], need[2]), need, cap)


def best_state(order: list[int], by_tokens: dict[int, set[tuple[int, int, int]]], need: tuple[int, int, int], cap: Capacity) -> tuple[int, int, int] | None:
    """The best of all open bins, the least among equals; order: the token residuals of open bins, sorted.

    By either rule a level's least possible score grows with its tokens, so
    levels from one that cannot win are left out without a change of the choice.
    """
    best = None
    for tokens in order[bisect.bisect_left(order, need[0]) :]:
        if best is not None and _least_score(tokens, need, cap) > best[0] + 1e-12:
            break
        for s in by_tokens[tokens]:
            if s[1] >= need[1] and s[2] >= need[2]:
                found = (_score(s, need, cap), s)
                best = found if best is None else min(best, found)
    return best and best[1]


def plan_bins(counts: dict[int, int], cap: Capacity = Capacity()) -> Plan:
    """Places all pieces, given how many there are of each length.

    A record of equal bins is a span of sequence numbers.  Placing `count`
    pieces of one length takes whole records as long as they fit, then splits
    one; each step closes a record or uses up the length, so the work depends
    on the number of lengths and not on the number of pieces.
    """
    open_bins: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)  # state: spans (first, bins)
    by_tokens: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
    order: list[int] = []
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used = 0

    def put(state: tuple[int, int, int], span: tuple[int, int]) -> None:
        if state[0] <= 0 or state[1] <= 0:
            return
        open_bins[state].append(span)
        if not by_tokens[state[0]]:
            bisect.insort(order, state[0])
        by_tokens[state[0]].add(state)

    def take(state: tuple[int, int, int]) -> tuple[int, int]:
        span = open_bins[state].pop()
        if not open_bins[state]:
            del open_bins[state]
            by_tokens[state[0]].discard(state)
            if not by_tokens[state[0]]:
                order.remove(state[0])
        return span

    for length in sorted(counts, reverse=True):
        need = (length, 1, length * length)
        if length > cap.tokens or need[2] > cap.cost:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rank, left = 0, counts[length]
        while left:
            state = best_state(order, by_tokens, need, cap)
            if state is None:
                state = (cap.tokens, cap.documents, cap.cost)
                each = min(state[0] // length if length else left, state[1], state[2] // need[2] if need[2] else left)
                first, bins = used, max(1, left // each)
                used += bins
            else:
                first, bins = take(state)
                each = min(state[0] // length if length else left, state[1], state[2] // need[2] if need[2] else left)
            each = min(each, left) if bins == 1 else each
            if bins * each > left:
                full = max(1, left // each)
                each = min(each, left)
                put(state, (first + full, bins - full))
                bins = full
            runs[length].append((rank, first, bins, each))
            rank, left = rank + bins * each, left - bins * each
            put((state[0] - each * length, state[1] - each, state[2] - each * need[2]), (first, bins))
    return Plan(dict(runs), used)


def split_pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, length: int = LENGTH, spaces: bool = True, known: int = KNOWN) -> DataFrame:
    """Encodes whole texts and cuts what is longer than a sequence; one row for each piece.

    task and nth: the input task and the piece's rank in it among those of its length.
    known: chunks of texts that a worker remembers; fewer take less memory and more time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, end, task = encoder(vocabulary, spaces, known), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, dtype=np.int64)
        for rows in slices(batches):
            out = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                packed = memoryview(codec.encode(text) + end)
                for k, (at, n) in enumerate(pieces_of(len(packed) // 4, length)):
                    out.append((doc, k, at, n, zlib.crc32(packed[4 * at : 4 * (at + n)]), task, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).transform(mapped, cut, PIECE_SCHEMA)


def pack(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """Adds sequence_id and offset to the rows of split_pieces."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    plan = plan_bins(counts, cap)
    from pyspark.sql import Window

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    lookup = spark.sparkContext.broadcast({n: (np.array(r, dtype=np.int64), cap.tokens) for n, r in _with_offsets(plan).items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lengths, ranks = rows.column(3).to_numpy(), rows.column(5).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                mine = lengths == n
                runs = lookup.value[int(n)][0]
                run = runs[np.searchsorted(runs[:, 0], ranks[mine], side="right") - 1]
                inside = ranks[mine] - run[:, 0]
                sequence[mine] = run[:, 1] + inside // run[:, 3]
                offset[mine] = run[:, 4] + inside % run[:, 3] * n
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").transform(mapped, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _with_offsets(plan: Plan) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Adds to each run the tokens already in its bins: bins of a run have had the same pieces before."""
    filled: list[tuple[int, int]] = []  # (first bin, tokens), sorted; a bin takes the last entry at or before it
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for length in sorted(plan.runs, reverse=True):
        out[length] = []
        for rank, first, bins, each in plan.runs[length]:
            k = bisect.bisect_right(filled, (first, 1 << 62)) - 1
            before = filled[k][1] if k >= 0 else 0
            out[length].append((rank, first, bins, each, before))
            j = bisect.bisect_left(filled, (first + bins, -1))
            tail = filled[j - 1][1] if j else 0
            inside = slice(bisect.bisect_left(filled, (first, -1)), j)
            after = [] if j < len(filled) and filled[j][0] == first + bins else [(first + bins, tail)]
            filled[inside] = [(first, before + each * length), *after]
    return out


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame, vocabulary: str | None = None, cap: Capacity = Capacity(), known: int = KNOWN) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack(stored(split_pieces(docs, vocabulary, length=cap.tokens, known=known), "pieces"), cap)
