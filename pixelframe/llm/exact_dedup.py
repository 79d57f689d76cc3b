"""Exact deduplication of a batch against a history held in minimal perfect hash tables.

The distinct digests of the history are dealt into shards of bounded size.
Each shard gets a minimal perfect hash function: levels of bit arrays in which
a digest owns the first bit that no other digest of its level wants, and the
rank of that bit is its slot.  A slot holds the full digest, the locator of
the winning document and the number of copies.  A digest of the new batch is
looked up in its shard and compared byte by byte with the slot it falls on;
members join the historical group, nonmembers form groups of their own.

Only (doc_id, digest) pairs are shuffled, never texts.  Copies are counted
before any shuffle, so a text that a third of all rows repeat is one record.

Defined results: null text is the empty text; empty texts equal each other;
null ids take part but never win over other ids; rows repeated with their id
are the same document and share its result; empty tables give an empty result;
columns other than the id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import discard, join_groups, stored, table, text_of

SHARD_KEYS = 16_384
GAMMA = 2.0
LEVELS = 96
WIDTH = 32
GROUP = "digest binary, winner long, named boolean, group_size long, member boolean"


def _mixed(first: np.ndarray, second: np.ndarray, level: int) -> np.ndarray:
    x = first + second * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return x


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digests).view("<u8")
    return words[:, 0].copy(), words[:, 1].copy()


class PerfectHash:
    """A minimal perfect hash function over distinct 32-byte digests."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0] + [int(x.sum()) for x in levels])
        self.ranks = [np.cumsum(x, dtype=np.int64) - 1 for x in levels]

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        first, second = _halves(digests)
        levels = []
        for level in range(LEVELS):
            if not len(first):
                return cls(levels)
            size = max(int(math.ceil(GAMMA * len(first))), 2)
            at = (_mixed(first, second, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = ~alone[at]
            first, second = first[left], second[left]
        raise ValueError("digests repeat")

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where it surely is no member."""
        first, second = _halves(digests)
        out = np.full(len(first), -1, dtype=np.int64)
        left = np.arange(len(first))
        for level, bits in enumerate(self.levels):
            at = (_mixed(first[left], second[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.ranks[level][at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @classmethod
    def load(cls, bits: bytes, sizes: list[int]) -> PerfectHash:
        levels, at = [], 0
        for size in sizes:
            n = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(bits[at : at + n], dtype=np.uint8), count=size).astype(bool))
            at += n
        return cls(levels)


def _array(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), dtype=np.uint8).reshape(-1, WIDTH)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    digests = _array(frame["digest"])
    function = PerfectHash.build(digests)
    slot = function.slots(digests)
    held, winners, counts, named = np.empty_like(digests), np.empty(len(frame), "<i8"), np.empty(len(frame), "<i8"), np.empty(len(frame), bool)
    held[slot], winners[slot], counts[slot], named[slot] = digests, frame["winner"].to_numpy(), frame["copies"].to_numpy(), frame["named"].to_numpy()
    bits, sizes = function.dump()
    return pd.DataFrame([{"shard": frame["shard"].iloc[0], "bits": bits, "sizes": sizes, "digests": held.tobytes(), "winners": winners.tobytes(), "named": named.tobytes(), "counts": counts.tobytes()}])


def _probe(tables: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """Slots with what the batch adds to them, and the batch's nonmembers."""
    if len(tables):
        x = tables.iloc[0]
        held = np.frombuffer(x["digests"], dtype=np.uint8).reshape(-1, WIDTH)
        winners, counts = np.frombuffer(x["winners"], "<i8").copy(), np.frombuffer(x["counts"], "<i8").copy()
        named = np.frombuffer(x["named"], dtype=bool).copy()
        function = PerfectHash.load(x["bits"], list(x["sizes"]))
    else:
        held, winners, counts, named, function = np.empty((0, WIDTH), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), PerfectHash([])
    new, found, has_id, copies = _array(batch["digest"]), batch["winner"].to_numpy(), batch["named"].to_numpy(dtype=bool), batch["copies"].to_numpy()
    slot = function.slots(new)
    same = slot >= 0
    same[same] = (held[slot[same]] == new[same]).all(axis=1)
    at = slot[same]
    counts[at] += copies[same]
    larger = has_id[same] & (~named[at] | (found[same] > winners[at]))
    winners[at[larger]] = found[same][larger]
    named[at] |= has_id[same]
    digests = [x.tobytes() for x in held] + [x.tobytes() for x in new[~same]]
    join = lambda old, rest: np.concatenate((old, rest[~same]))
    return pd.DataFrame({"digest": digests, "winner": join(winners, found), "named": join(named, has_id), "group_size": join(counts, copies), "member": np.arange(len(digests)) < len(held)})


def grouped(digests: DataFrame) -> DataFrame:
    """One record for each distinct digest: the winning id, whether there is one, and the number of copies.

    No column is ever null: pandas would turn nullable ids into floats, which
    hold no ids above 2 ** 53.
    """
    return digests.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("winner"), F.max("doc_id").isNotNull().alias("named"), F.count(F.lit(1)).alias("copies"))


def history_tables(groups: DataFrame, shards: int) -> DataFrame:
    """One minimal perfect hash table for each shard of the historical digests."""
    return (
        groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_build, "shard long, bits binary, sizes array<int>, digests binary, winners binary, named binary, counts binary")
    )


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("digest"))


def exact_groups(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Groups of equal texts over history and batch, both (doc_id, digest).

    Shards are sized by the larger side, so neither fills a task's memory.
    """
    ship(history.sparkSession)
    old, new = stored(grouped(history), "dedup-history"), stored(grouped(batch), "dedup-batch")
    shards = max(1, math.ceil(max(old.count(), new.count()) / SHARD_KEYS))
    new = new.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    groups = history_tables(old, shards).groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_probe, GROUP)
    groups = stored(groups.select("digest", F.when(F.col("named"), F.col("winner")).alias("keep_id"), "group_size", "member"), "dedup-groups")
    discard(old, new)
    return groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_share: float = 0.5) -> DataFrame:
    """Marks every document with the largest id among its equals.

    The table is taken as an ingested history (about history_share of the rows,
    those with the least ids) and a new batch (the rest); the result is the
    same for any share.
    """
    digests = stored(digested(docs, id_col, text_col), "dedup-digests")
    border, total = digests.agg(F.percentile_approx("doc_id", history_share), F.count(F.lit(1))).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(border), F.lit(True)) if history_share > 0 else F.lit(False)
    groups = exact_groups(digests.filter(old), digests.filter(~old))
    return join_groups(digests, groups, "digest", "group_size", total).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("in_history")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
