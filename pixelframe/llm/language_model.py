"""Scores of texts under a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words and an end.  The most frequent words, as many as
UNITS_BY_ROOT times the square root of the training tokens and at most
MOST_UNITS (144 MB of vectors), are units with vectors of their own, so units
grow with the corpus; rarer words share a unit with all rare words that end
alike.  Units are dealt into classes: the end and the CLASS_WORDS most frequent
words are classes of one, the others go by their ending, MEMBERS to a class.

The vectors of the two units before a token, each through the matrix of its
place, add up to a predicted vector.  Its products with all class vectors, plus
biases, give the probability of the token's class, and those with the vectors
of the class's units that of the unit: both are divided by their whole sums, in
batches of matrix products, so probabilities add up to one.  Within a shared
unit a word has its share of the unit's tokens, less the share that the unit
gives to words never seen (the Good-Turing estimate).

All counts and all training are over all training documents, dealt into ROUNDS
parts.  In each round, tasks train on their tokens of one part by sampled
noise, classes against classes and units against units of their class, from the
same vectors; what they change is averaged by unit with the unit's counts as
weights, in Spark, FAN shards at a time and level by level.  Only units that a
task met are shuffled, and one record for each block of units reaches the driver.

Counts of the HEAD most frequent words are broadcast, and words and vectors of
all units.  Other words are joined with their counts by a shuffle, one row for
each document and word.

Defined results: null texts are empty and have one end; null ids are training
rows; an empty training set gives every token the unknown word's probability;
repeated rows are scored each; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, remainder, slices, stored, table, text_of

HEAD = 200_000
UNITS_BY_ROOT = 1.5
MOST_UNITS = 1_000_000
CLASS_WORDS = 64
ENDINGS = 63
ENDING = 2  # characters
MEMBERS = 128
DIMENSION = 16
NOISE = 8  # noise classes to a token, as weighed
DRAWS = 32  # noise classes drawn for each batch
UNIT_NOISE = 1  # noise units to a token, of its class
ROUNDS = 3
BATCH = 4096
RATE = 0.1
SHARD_TOKENS, TOKENS_A_UNIT = 2_000_000, 16  # a shard's tokens: so many, and so many for each unit, so that shuffles stay in proportion to texts
FAN = 64  # shards whose changes one task averages
SMALL_TOKENS, MOST_PASSES = 4_000_000, 8  # a corpus of fewer tokens is passed over more than once
BLOCKS = 256
SCORED = 1024  # tokens whose sums are worked out at once
SAFE = 80.0  # scores below it have exponentials within float32
READ_ROWS = 1024  # texts that are split at once, and whose distinct words are looked up
KEPT_WORDS = 400_000  # while counting
END = b""  # no word is empty
DIVISOR, HELD_OUT = 7, 2


def words_of(text: str) -> list[bytes]:
    """Words of a text; bytes.lower changes A-Z only and bytes.split cuts at the contract's white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Words(dict):
    """Numbers of words in the order in which they are met, until KEPT_WORDS are known and all are forgotten."""

    def __init__(self):
        super().__init__()
        self.known: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.known)
        self.known.append(word)
        return k

    def forget(self) -> None:
        self.clear()
        self.known = []

    def read(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and the numbers of all words in order."""
        sizes, codes, words = split(texts)
        return sizes, np.fromiter(map(self.__getitem__, bytes_of(words)), np.int32, len(words))[codes]


def placed(sizes: np.ndarray, values: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """values of texts between two edges before and one after each, and the places of all but those before."""
    begins = np.cumsum(sizes + 3) - (sizes + 3)
    out, real = np.full(int((sizes + 3).sum()), edge, values.dtype), np.ones(int((sizes + 3).sum()), bool)
    real[begins] = real[begins + 1] = False
    at = np.flatnonzero(real)
    inner = np.ones(len(at), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    out[at[inner]] = values
    return out, at


def ending(word: bytes) -> bytes:
    last = word[-ENDING:]
    return last if last.isascii() else word.decode("utf-8", "surrogatepass")[-ENDING:].encode("utf-8", "surrogatepass")


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", DIVISOR) == HELD_OUT, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, ends under the empty word; counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, ends = Words(), np.zeros(0, np.int64), 0
        batch = lambda found, n: pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])
        for rows in slices(batches, READ_ROWS):
            _, codes = words.read(rows.column(0))
            found = np.bincount(codes, minlength=len(words.known))
            found[: len(counts)] += counts
            counts, ends = found, ends + rows.num_rows
            if len(counts) > KEPT_WORDS:
                yield batch(words.known, counts)
                words.forget()
                counts = counts[:0]
        if ends:
            yield batch([*words.known, END], np.append(counts, ends))

    return docs.select(text_of().alias("text")).transform(mapped, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def last_characters() -> Column:
    return F.encode(F.substring(F.decode("word", "UTF-8"), -ENDING, ENDING), "UTF-8")


@dataclass
class Vocabulary:
    """Units in the order of their classes: 0 is the end, shared units stand among the units of their ending."""

    own: dict[bytes, int]  # the units of one word
    endings: dict[bytes, int]  # the shared unit of each listed ending
    rest: int  # the shared unit of all other rare words
    class_of: np.ndarray  # by unit
    first: np.ndarray  # by class its first unit, and the number of units

    @property
    def size(self) -> int:
        return len(self.class_of)

    @property
    def shared(self) -> np.ndarray:
        """Shared units: one for each listed ending, and the rest."""
        return np.array([*self.endings.values(), self.rest], np.int64)

    def of(self, words: list[bytes]) -> list[int]:
        """The unit of each word."""
        return self.units_of(pa.array(words, pa.binary()).cast(pa.string())).tolist()

    def units_of(self, words: pa.Array) -> np.ndarray:
        """The unit of each word: its own, or the shared one of its ending."""
        found = numbers(self.own, words)
        rare = np.flatnonzero(found < 0)
        endings = pc.utf8_slice_codeunits(words.take(pa.array(rare)), -ENDING).dictionary_encode()
        listed = np.array([self.endings.get(e, self.rest) for e in bytes_of(endings.dictionary)], np.int32)
        found[rare] = listed[endings.indices.to_numpy()]
        return found


def bytes_of(words: pa.Array) -> list[bytes]:
    """Words, in which there is no white space, as bytes."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_buffer().to_pybytes().split()


def numbers(known: dict[bytes, int], words: pa.Array) -> np.ndarray:
    """What is known of each word, or -1."""
    return np.fromiter(map(known.get, bytes_of(words), repeat(-1)), np.int32, len(words))


def split(texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each text has, and all words in order as places among the distinct ones, which follow.

    As words_of: ascii_lower changes A-Z only and ascii_split_whitespace cuts at
    the contract's white space, but has empty parts at the ends of a text.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))
    words = parts.flatten()
    real = pc.binary_length(words).to_numpy() > 0
    sizes = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(real)))[parts.offsets.to_numpy()])
    coded = (words if real.all() else words.filter(pa.array(real))).dictionary_encode()
    return sizes, coded.indices.to_numpy(), coded.dictionary.cast(pa.string())


def least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach, from the numbers of words by eighths of a power of two: at most 512 records."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["level"]: (r["size"], r["least"]) for r in counts.filter(F.col("word") != F.lit(END)).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).collect()}
    least, taken = 1 << 62, 0
    for k in sorted(sizes, reverse=True):
        taken += sizes[k][0]
        if taken > most:
            break
        least = sizes[k][1]
    return least


def rare_words(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter((F.col("n") < least) & (F.col("word") != F.lit(END)))


def choose_vocabulary(counts: DataFrame, least: int) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """All words of at least `least` tokens and the most frequent endings of the others.

    Also by unit its tokens, and for shared units the share kept for unknown words.
    """
    own = counts.filter((F.col("n") >= least) & (F.col("word") != F.lit(END))).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, n = own.column("word").to_pylist(), own.column("n").to_numpy()
    rest = rare_words(counts, least).groupBy(last_characters().alias("ending")).agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once"))
    rest = stored(rest, "lm-endings")
    listed = [bytes(r["ending"]) for r in rest.orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()]
    sums = {r["ending"] and bytes(r["ending"]): (r["n"], r["once"]) for r in rest.groupBy(F.when(F.col("ending").isin(listed), F.col("ending")).alias("ending")).agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect()}
    end = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # (class key, tokens, word or ending): frequent words alone, the others by ending from the most frequent to the shared unit
    groups: dict[bytes | None, list] = {e: [] for e in [*listed, None]}
    tops = []
    for k, w in enumerate(words):
        if k < CLASS_WORDS:
            tops.append([(n[k], w)])
        else:
            groups.get(ending(w), groups[None]).append((n[k], w))
    classes = [[(end, END)], *tops]
    shared = {}
    for e, members in groups.items():
        members = [*members, (sums.get(e, (0, 0))[0], None)]
        pieces = [members[at : at + MEMBERS] for at in range(0, len(members), MEMBERS)]
        shared[e] = sum(map(len, classes)) + len(members) - 1
        classes += pieces
    flat = [x for c in classes for x in c]
    sizes = np.array([len(c) for c in classes])
    vocabulary = Vocabulary({w: k for k, (_, w) in enumerate(flat) if w}, {e: shared[e] for e in listed}, shared[None], np.repeat(np.arange(len(classes)), sizes), np.concatenate(([0], np.cumsum(sizes))))
    tokens, unknown = np.array([float(x[0]) for x in flat]), np.zeros(len(flat))
    for e, k in shared.items():
        seen, once = sums.get(e, (0, 0))
        unknown[k] = min((once + 0.5) / (seen + 1), 0.9) if seen else 1.0
    return vocabulary, tokens, unknown


@dataclass
class Network:
    """The log-bilinear network; used: sums of squared gradients (AdaGrad) of context, target and bias, or of class vectors and biases."""

    context: np.ndarray  # units x DIMENSION
    target: np.ndarray  # units x DIMENSION
    bias: np.ndarray
    used: np.ndarray  # units x 3
    places: np.ndarray  # 2 x DIMENSION x DIMENSION
    classes: np.ndarray  # classes x (DIMENSION + 1): vectors and biases
    class_used: np.ndarray  # classes x 2

    @classmethod
    def start(cls, vocabulary: Vocabulary, noise: np.ndarray, seed: int = 11) -> Network:
        """Small random vectors; biases by frequency, of classes and of units within their class."""
        random = np.random.default_rng(seed)
        small = lambda n: (0.1 * random.standard_normal((n, DIMENSION))).astype(np.float32)
        of_class = np.add.reduceat(noise, vocabulary.first[:-1])
        classes = np.concatenate((small(len(of_class)), np.log(of_class / noise.sum())[:, None]), axis=1).astype(np.float32)
        bias = np.log(noise / of_class[vocabulary.class_of]).astype(np.float32)
        places = np.stack([np.eye(DIMENSION, dtype=np.float32)] * 2)
        return cls(small(vocabulary.size), small(vocabulary.size), bias, np.full((vocabulary.size, 3), 0.01, np.float32), places, classes, np.full((len(of_class), 2), 0.01, np.float32))

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """Context vectors through the matrix of each place."""
        return self.context @ self.places[0], self.context @ self.places[1]

    def log_probabilities(self, vocabulary: Vocabulary, moved: tuple[np.ndarray, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each target after its two contexts, divided by whole sums."""
        out = np.empty(len(target), np.float32)
        own = vocabulary.class_of[target].astype(np.int16 if len(self.classes) < 1 << 15 else np.int32)
        order = np.argsort(own, kind="stable")
        # by class, so that the members' vectors are at hand; the last column meets the biases
        guess = np.ones((len(target), DIMENSION + 1), np.float32)
        guess[:, :-1] = moved[0][one[order]]
        guess[:, :-1] += moved[1][two[order]]
        own, target = own[order], target[order]
        found = _log_shares(guess, np.ascontiguousarray(self.classes.T), own)
        ends = np.flatnonzero(np.diff(own, append=-1)) + 1
        for low, high in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()):
            first, last = vocabulary.first[own[low]], vocabulary.first[own[low] + 1]
            if last > first + 1:
                vectors = np.concatenate((self.target[first:last].T, self.bias[None, first:last]))
                found[low:high] += _log_shares(guess[low:high], vectors, target[low:high] - first)
        out[order] = found
        return out


def _log_shares(guess: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The logarithm of the chosen columns' shares in the sums of exponentials of guess @ vectors, row by row."""
    out = np.empty(len(guess), np.float32)
    reach = np.sqrt((vectors[:-1] ** 2).sum(axis=0).max()) * np.sqrt((guess[:, :-1] ** 2).sum(axis=1).max(initial=0)) + np.abs(vectors[-1]).max()
    for at in range(0, len(guess), SCORED):
        part = slice(at, at + SCORED)
        scores = guess[part] @ vectors
        picked = scores[np.arange(len(scores)), chosen[part]]
        if reach > SAFE:
            top = scores.max(axis=1)
            scores -= top[:, None]
            picked -= top
        np.exp(scores, out=scores)
        out[part] = picked - np.log(scores.sum(axis=1))
    return out


def _sums_by_row(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of `at`, which may repeat, and the sums of g by row."""
    order = np.argsort(at, kind="stable")
    found = at[order]
    first = np.flatnonzero(found[1:] != found[:-1])
    first = np.concatenate((np.zeros(1, first.dtype), first + 1))
    return found[first], np.add.reduceat(g[order], first, axis=0)


def _climb(x: np.ndarray, used: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """An AdaGrad step on distinct rows of x, vectors with a bias at the end, along g; used: squares of both."""
    squares = used[rows]
    squares[:, 0] += np.einsum("ij,ij->i", g[:, :DIMENSION], g[:, :DIMENSION]) / DIMENSION
    if g.shape[1] > DIMENSION:
        squares[:, 1] += g[:, DIMENSION] ** 2
    used[rows] = squares
    scale = RATE / np.sqrt(squares)
    g[:, :DIMENSION] *= scale[:, :1]
    g[:, DIMENSION:] *= scale[:, 1:]
    x[rows] += g


def _sigma(s: np.ndarray) -> np.ndarray:
    s = np.tanh(s * np.float32(0.5))
    s += 1
    s *= np.float32(0.5)
    return s


def train_shard(net: Network, vocabulary: Vocabulary, noise: np.ndarray, one: np.ndarray, two: np.ndarray, target: np.ndarray, seed: int, passes: int = 1) -> tuple[np.ndarray, np.ndarray, Network]:
    """Passes over a shard's tokens in batches: units met, their tokens, and what changed.

    A token's class is told from DRAWS noise classes of its batch, each weighed
    NOISE / DRAWS, and its unit from UNIT_NOISE units, those of as many tokens
    of the class drawn from the shard.
    """
    random = np.random.default_rng(seed)
    tokens = np.bincount(target, minlength=len(noise))
    met = np.zeros(len(noise), bool)
    for x in (one, two, target):
        met[x] = True
    units = np.flatnonzero(met)
    kind = np.uint16 if len(units) <= 1 << 16 else np.int32  # short numbers are sorted by radix
    place = np.zeros(len(noise), kind)
    place[units] = np.arange(len(units))
    own = vocabulary.class_of[target].astype(np.uint16 if len(net.classes) <= 1 << 16 else np.int32)
    one, two, word = place[one], place[two], place[target]
    # units as often as they have tokens, class by class: units stand in the order of their classes
    pool = np.repeat(np.arange(len(units)), tokens[units]).astype(kind)
    sizes = np.bincount(vocabulary.class_of[units], tokens[units], len(net.classes)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    class_noise = np.add.reduceat(noise, vocabulary.first[:-1])
    several = np.diff(vocabulary.first) > 1

    c, t = net.context[units], np.concatenate((net.target[units], net.bias[units, None]), axis=1)
    c_used, t_used = net.used[units][:, :1].copy(), net.used[units][:, 1:].copy()
    v, v_used = net.classes.copy(), net.class_used.copy()
    places, places_used = net.places.copy(), np.full_like(net.places, 1.0)
    class_shift = np.log(NOISE * class_noise / class_noise.sum()).astype(np.float32)
    unit_shift = np.log(UNIT_NOISE * noise / class_noise[vocabulary.class_of]).astype(np.float32)[units]
    weight, class_total = np.float32(NOISE / DRAWS), np.cumsum(class_noise)
    order = np.concatenate([random.permutation(len(target)) for _ in range(passes)])
    for at in range(0, len(order), BATCH):
        mine = order[at : at + BATCH]
        i, j, k = one[mine], two[mine], own[mine]
        ci, cj = c[i], c[j]
        guess = np.ones((len(mine), DIMENSION + 1), np.float32)  # the last column meets the biases
        np.matmul(ci, places[0], out=guess[:, :-1])
        guess[:, :-1] += cj @ places[1]
        q = np.minimum(np.searchsorted(class_total, random.random(DRAWS) * class_total[-1]), len(v) - 1).astype(k.dtype)
        vk, vq = v[k], v[q]
        up = 1 - _sigma(np.einsum("ij,ij->i", guess, vk) - class_shift[k])
        down = -weight * _sigma(guess @ vq.T - class_shift[q])
        back = up[:, None] * vk
        back += down @ vq
        class_step = _sums_by_row(np.concatenate((k, q)), np.concatenate((up[:, None] * guess, down.T @ guess)))

        inner = np.flatnonzero(several[k])
        near, ki, unit_step = guess[inner], k[inner], []
        drawn = [pool[starts[ki] + (random.random(len(inner)) * sizes[ki]).astype(np.int64)] for _ in range(UNIT_NOISE)]
        rows, steps, pull = [word[mine[inner]], *drawn], [], np.zeros_like(near)
        for right, w in enumerate(rows):
            tw = t[w]
            s = np.float32(not right) - _sigma(np.einsum("ij,ij->i", tw, near) - unit_shift[w])
            s = s[:, None]
            pull += s * tw
            steps.append(s * near)
        if len(inner):
            back[inner] += pull
            unit_step = [_sums_by_row(np.concatenate(rows), np.concatenate(steps))]

        back = back[:, :-1]
        moved = np.stack([ci.T @ back, cj.T @ back])
        _climb(c, c_used, *_sums_by_row(np.concatenate((i, j)), np.concatenate((back @ places[0].T, back @ places[1].T))))
        _climb(v, v_used, *class_step)
        for step in unit_step:
            _climb(t, t_used, *step)
        places_used += moved * moved
        places += 0.5 * RATE * moved / np.sqrt(places_used)
    changed = Network(
        c - net.context[units],
        t[:, :-1] - net.target[units],
        t[:, -1] - net.bias[units],
        np.concatenate((c_used, t_used), axis=1) - net.used[units],
        places - net.places,
        v - net.classes,
        v_used - net.class_used,
    )
    return units, tokens[units], changed


CHANGES = "block int, shard int, units binary, weights binary, vectors binary, others binary"


def _average(found: pa.Table) -> pa.Table:
    """Changes of one block of units, averaged with their weights (tokens and one), which add up; those of places and classes are block BLOCKS."""
    block, shard = (found.column(k)[0].as_py() for k in range(2))
    rows = list(zip(*(found.column(k).to_pylist() for k in range(2, 6))))
    weights = [np.frombuffer(r[1], np.float32) for r in rows]
    if block == BLOCKS:
        total = np.array([sum(float(w[0]) for w in weights)], np.float32)
        vectors = sum(w[0] / total[0] * np.frombuffer(r[2], np.float32) for w, r in zip(weights, rows)).astype(np.float32)
        units, others = np.zeros(0, np.int32), sum(np.frombuffer(r[3], np.float32) for r in rows)
    else:
        units, place = np.unique(np.concatenate([np.frombuffer(r[0], np.int32) for r in rows]), return_inverse=True)
        sums, total = np.zeros((len(units), 2 * DIMENSION + 1), np.float32), np.zeros(len(units), np.float32)
        gained, at = np.zeros((len(units), 3), np.float32), 0
        for r, w in zip(rows, weights):
            mine, at = place[at : at + len(w)], at + len(w)
            other = np.frombuffer(r[3], np.float32).reshape(-1, 4)
            total[mine] += w
            sums[mine, :-1] += w[:, None] * np.frombuffer(r[2], np.float16).reshape(len(w), -1)
            sums[mine, -1] += w * other[:, 0]
            gained[mine] += other[:, 1:]
        sums /= total[:, None]
        vectors, others = sums[:, :-1].astype(np.float16), np.concatenate((sums[:, -1:], gained), axis=1)
    parts = (units.astype(np.int32), total, vectors, others.astype(np.float32))
    return pa.table({"block": pa.array([block], pa.int32()), "shard": pa.array([shard], pa.int32())} | {name: [x.tobytes()] for name, x in zip(("units", "weights", "vectors", "others"), parts)})


def averaged(changes: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """One record for each block; no task averages more than about fan of shards changes."""
    while shards > 1:
        shards = -(-shards // fan)
        changes = changes.withColumn("shard", F.pmod("shard", F.lit(shards)).cast("int")).groupBy("block", "shard").applyInArrow(_average, CHANGES)
    return changes


def train_round(docs: DataFrame, vocabulary: Vocabulary, net: Network, noise: np.ndarray, seed: int, passes: int) -> None:
    """Trains net on all texts of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, net, noise))
    most = max(SHARD_TOKENS, TOKENS_A_UNIT * vocabulary.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, net, noise = shared.value
        texts, size, made = [], 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal made
            one, two, target = (np.concatenate(x) for x in zip(*texts))
            texts.clear()
            number, made = (TaskContext.get().partitionId() + 7919 * made) % (1 << 30), made + 1
            units, n, changed = train_shard(net, vocabulary, noise, one, two, target, seed, passes)
            others = np.concatenate((changed.bias[:, None], changed.used), axis=1).astype(np.float32)
            vectors = np.concatenate((changed.context, changed.target), axis=1).astype(np.float16)
            rows = [(k, number, units[m].astype(np.int32).tobytes(), (n[m] + 1).astype(np.float32).tobytes(), vectors[m].tobytes(), others[m].tobytes()) for k in range(BLOCKS) if (m := units % BLOCKS == k).any()]
            dense = np.concatenate((changed.places.ravel(), changed.classes.ravel())).astype(np.float32)
            rows.append((BLOCKS, number, b"", np.array([len(target)], np.float32).tobytes(), dense.tobytes(), changed.class_used.astype(np.float32).tobytes()))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["block", "shard", "units", "weights", "vectors", "others"])

        for rows in slices(batches, READ_ROWS):
            sizes, codes, words = split(rows.column(0))
            units, at = placed(sizes, vocabulary.units_of(words)[codes], 0)
            texts.append((units[at - 2], units[at - 1], units[at]))
            size += len(at)
            if size > most:
                yield shard()
                size = 0
        if texts:
            yield shard()

    texts = docs.select(text_of().alias("text"))
    shards = texts.rdd.getNumPartitions() + int(noise.sum() // most)
    for r in averaged(texts.transform(mapped, run, CHANGES), shards).toArrow().to_pylist():
        units = np.frombuffer(r["units"], np.int32)
        if r["block"] == BLOCKS:
            dense = np.frombuffer(r["vectors"], np.float32)
            net.places += dense[: net.places.size].reshape(net.places.shape)
            net.classes += dense[net.places.size :].reshape(net.classes.shape)
            net.class_used += np.frombuffer(r["others"], np.float32).reshape(net.class_used.shape)
            continue
        vectors = np.frombuffer(r["vectors"], np.float16).reshape(len(units), -1)
        others = np.frombuffer(r["others"], np.float32).reshape(len(units), -1)
        net.context[units] += vectors[:, :DIMENSION]
        net.target[units] += vectors[:, DIMENSION:]
        net.bias[units] += others[:, 0]
        net.used[units] += others[:, 1:]
    shared.unpersist()


def fit_network(learnt: DataFrame, vocabulary: Vocabulary, tokens: np.ndarray, rounds: int = ROUNDS) -> Network:
    """Vectors of all units from all texts, each text in one round."""
    noise = tokens + 0.5
    passes = int(np.clip(SMALL_TOKENS / max(tokens.sum(), 1), 1, MOST_PASSES))
    net, part = Network.start(vocabulary, noise), F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds):
        train_round(learnt.filter(part.eqNullSafe(F.lit(k))), vocabulary, net, noise, k, passes)
    return net


@dataclass
class Tables:
    """What scoring needs of the corpus: words up to HEAD, and all units. A word's index is its place among the former, or their number plus its unit."""

    head: dict[bytes, int]
    vocabulary: Vocabulary
    unit_of: np.ndarray  # by index
    base_of: np.ndarray  # log10 base score; 0 where the word is joined with its count later
    share_of: np.ndarray  # log10 share of the word in its unit; 0 where it is joined later
    known_of: np.ndarray
    shared_of: np.ndarray  # by unit: 1 + its place among the shared units, 0 for a unit of one word
    network: Network


def _log10_base(n, total: int, distinct: int):
    return np.log10((np.asarray(n, float) + 1) / (total + distinct + 1))


def score_parts(docs: DataFrame, tables: Tables) -> DataFrame:
    """One row for each document with what the head words and the network give, and one for each of its other words.

    The former have a word that starts with a space, which no real word does,
    so all rows take the same join and no key is hot.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ["row", "doc_id", "word", "unit", "times", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        moved, limit, end = t.network.moved(), len(t.head), t.head[END]
        for rows in slices(batches, READ_ROWS):
            found = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            sizes, codes, words = split(rows.column(2))
            places = numbers(t.head, words)
            others = np.flatnonzero(places < 0)
            places[others] = limit + t.vocabulary.units_of(words.take(pa.array(others)))
            index, at = placed(sizes, places[codes], end)
            unit, index = t.unit_of[index], index[at]
            logs = t.network.log_probabilities(t.vocabulary, moved, unit[at - 2], unit[at - 1], unit[at]) / np.log(10) + t.share_of[index]
            starts = np.cumsum(sizes + 1) - (sizes + 1)
            score, base, known = (np.add.reduceat(x, starts) for x in (logs, t.base_of[index], t.known_of[index]))
            one = np.ones(len(starts), np.int32)
            whole = (*found, [b" %d" % row for row in found[0]], 0 * one, one, sizes + 1, known, base, score)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(whole, kinds)], names)
            # the other words, once for each text they are in
            rare = np.flatnonzero(index >= limit)
            owner = np.searchsorted(starts, rare, side="right") - 1
            distinct = len(words) + 1
            pairs, first, times = np.unique(owner * distinct + codes[rare - owner], return_index=True, return_counts=True)
            words = words.take(pa.array(pairs % distinct)).cast(pa.binary())
            none = np.zeros(len(pairs), np.int64)
            parts = (np.array(found[0], np.int64)[pairs // distinct], pa.nulls(len(pairs), pa.int64()), words, t.shared_of[unit[at[rare[first]]]], times, none, none, 0.0 * none, 0.0 * none)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x).cast(k) for x, k in zip(parts, kinds)], names)

    return mapped(docs, run, "row long, doc_id long, word binary, unit int, times int, n_tokens long, n_known long, base double, score double")


def score_documents(docs: DataFrame, train_on: Column | None = None, least: int | None = None) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score; least: tokens of a word with a unit of its own."""
    learnt = docs.filter(~held_out()) if train_on is None else docs.filter(train_on)
    counts = stored(count_words(learnt), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if least is None:
        least = least_count(counts, min(int(UNITS_BY_ROOT * total**0.5), MOST_UNITS))
    vocabulary, unit_tokens, unknown = choose_vocabulary(counts, least)
    network = fit_network(learnt, vocabulary, unit_tokens)

    shared = vocabulary.shared
    shared_of = np.zeros(vocabulary.size, np.int64)
    shared_of[shared] = 1 + np.arange(len(shared))
    head_least = least_count(counts, HEAD)
    ranked = counts.filter((F.col("n") >= head_least) | (F.col("word") == F.lit(END))).toArrow()
    head = {END: 0}
    sizes = [0]
    for word, n in zip(ranked.column("word").to_pylist(), ranked.column("n").to_pylist()):
        if word == END:
            sizes[0] = n
        else:
            head[word] = len(head)
            sizes.append(n)
    sizes = np.array(sizes, float)
    unit_of = np.array([0, *vocabulary.of([w for w in head if w != END]), *range(vocabulary.size)], np.int64)
    k = unit_of[: len(head)]
    share = np.log10(np.where(shared_of[k] > 0, (1 - unknown[k]) * np.maximum(sizes, 1) / np.maximum(unit_tokens[k], 1), 1.0))
    rest = np.zeros(vocabulary.size)
    tables = Tables(head, vocabulary, unit_of, np.concatenate((_log10_base(sizes, total, distinct), rest)), np.concatenate((share, rest)), np.concatenate(((sizes > 0).astype(np.int64), rest.astype(np.int64))), shared_of, network)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = score_parts(numbered, tables)
    by_unit = lambda x: F.element_at(F.array(F.lit(1.0), *[F.lit(float(y)) for y in x[shared]]), F.col("unit") + 1)
    known = F.col("n").isNotNull()
    real = ~F.col("word").startswith(F.lit(b" "))
    base = F.when(real, F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1.0) / F.lit(float(total + distinct + 1)))).otherwise(F.col("base"))
    inner = F.when(F.col("unit") == 0, 0.0).when(known, F.log10(by_unit(1 - unknown) * F.col("n") / by_unit(np.maximum(unit_tokens, 1)))).otherwise(F.log10(by_unit(unknown)))
    scored = rows.join(counts, "word", "left").select(
        "row",
        "doc_id",
        "n_tokens",
        F.when(real & known, F.col("times").cast("long")).otherwise(F.col("n_known")).alias("n_known"),
        base.alias("base_score"),
        F.when(real, F.col("times") * inner).otherwise(F.col("score")).alias("score"),
    )
    sums = scored.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
