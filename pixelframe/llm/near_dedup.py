"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is that of its distinct 2-word shingles.  Documents of equal
sets are one class, whose least id stands for it.  A class has a signature of
SYMBOLS minima cut to 16 bits.  At a similarity of 0.8 two signatures differ in
12.8 of 64 symbols on average and, but for about one pair in 20,000, in at most
DISTANCE.  Signatures are cut into CHUNKS chunks; by the pigeonhole principle
two signatures within DISTANCE have a chunk with at most DISTANCE // CHUNKS = 1
differing symbol.  So each chunk is a key once for each symbol left out, and
every pair within DISTANCE shares a key.  Links are confirmed on full sets.

A key's group may be large, and its pairs are never listed.  In each of ROUNDS
rounds a class is checked against one member, drawn anew by hash, of another
component in a group that it shares; what is linked falls together, so large
groups of near copies shrink to one component.  Groups that still hold several
components are then checked exhaustively, in tiles of bounded size that compare
signatures and then full sets in place and return only links that join
components.  Nothing is capped, so no link is lost.

Full sets are read by the classes that share a group with another one, one set
for each class; they are stored in hash buckets of their id once, and pairs are
brought to them.

Defined results: null texts are empty; documents without words have an empty
set and are linked with nothing; one word is one shingle; null ids are linked
with nothing and kept; repeated rows have the same result; an id that several
texts share is one document with the links of all of them; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .common import FORGETS, discard, join_groups, mapped, new_path, remove, slices, stored, table, text_of
from .components import components

SYMBOLS = 64
DISTANCE = 26
CHUNKS = 14
ROUNDS = 3
TILE = 512  # classes of a block, and
TILE_BYTES = 16 << 20  # bytes of their sets
KNOWN_WORDS = 200_000
NUMERATOR, DENOMINATOR = 80, 100
_RANDOM = np.random.default_rng(8)
MULTIPLIERS = (_RANDOM.integers(1, 1 << 32, SYMBOLS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
OFFSETS = _RANDOM.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)


def chunk_keys() -> list[tuple[int, ...]]:
    """The symbols of each key: every chunk with all choices of as many symbols left out as it may have errors."""
    errors = DISTANCE // CHUNKS
    return [kept for chunk in np.array_split(np.arange(SYMBOLS), CHUNKS) for kept in combinations(chunk.tolist(), len(chunk) - errors)]


KEYS = chunk_keys()
KEY_WEIGHTS = np.zeros((SYMBOLS, len(KEYS)), dtype=np.uint64)
for _k, _kept in enumerate(KEYS):
    KEY_WEIGHTS[list(_kept), _k] = _RANDOM.integers(1, 1 << 63, len(_kept), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEY_SEEDS = _RANDOM.integers(1, 1 << 63, len(KEYS), dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()
FORGETS.append(_WORDS.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 2-word shingles; bytes.split takes the same white space as the contract."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(words) == 1:
        return _mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(_mix(hashes[:-1] * np.uint64(0xA0761D6478BD642F) + _mix(hashes[1:])))


def signature(found: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of a non-empty set, cut to 16 bits."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, (MULTIPLIERS[:, None] * low[None, at : at + 2048] + OFFSETS[:, None]).min(axis=1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, signature) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            sizes, digests, signed = [], [], []
            for text in rows.column(1).to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signed.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "n_shingles", "digest", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).transform(mapped, run, "doc_id long, n_shingles long, digest binary, signature binary")


def key_rows(classes: DataFrame) -> DataFrame:
    """(key, id): one row for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 1024):
            symbols = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS).astype(np.uint64)
            keys = _mix(symbols @ KEY_WEIGHTS + KEY_SEEDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(rows.column(0).to_numpy(), len(KEYS)))], ["key", "id"])

    return classes.select("id", "signature").transform(mapped, run, "key long, id long")


class FullSets:
    """(id, found): the sets of the given documents, one for each id and text, in a table of hash buckets of id until the block ends."""

    def __init__(self, docs: DataFrame, ids: DataFrame, count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in slices(batches):
                found = [shingles(x).tobytes() for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([xxhash.xxh3_128_digest(x) for x in found], pa.binary()), pa.array(found, pa.binary())], ["id", "digest", "found"])

        self.spark, self.name = docs.sparkSession, f"near_sets_{uuid.uuid4().hex}"
        self.path = new_path(self.spark, "near-sets")
        buckets = min(max(count // 4096, 12), 20_000)
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(ids, "id", "left_semi")
        sets = rows.transform(mapped, run, "id long, digest binary, found binary").repartition(buckets, "id").dropDuplicates(["id", "digest"]).drop("digest")
        sets.write.bucketBy(buckets, "id").sortBy("id").option("path", self.path).format("parquet").saveAsTable(self.name)

    def __enter__(self) -> DataFrame:
        return self.spark.table(self.name)

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. Sets stay in their buckets; a pair brings b's set to a's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            kept = []
            for x, y in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist()):
                kept.append(_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(mask), rows.column(1).filter(mask)], ["a", "b"])

    one, two = sets.select(F.col("id").alias("b"), F.col("found").alias("found_b")), sets.select(F.col("id").alias("a"), F.col("found").alias("found_a"))
    carried = pairs.join(one.hint("merge"), "b").select("a", "b", "found_b")
    return carried.join(two.hint("merge"), "a").select("a", "b", "found_a", "found_b").transform(mapped, run, "a long, b long")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members (key, id) with their component: their own id where nothing links them."""
    if labels is None:
        return members.withColumn("component", F.col("id"))
    return members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))


def _mixed(members: DataFrame) -> DataFrame:
    """The keys whose group holds more than one component, with the group's size and its least id, the hub."""
    return members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).filter("low <> high").select("key", "hub", "size")


def _drawn(members: DataFrame, total: int, salt: int) -> DataFrame:
    """One pair for each class in a mixed group: with a member, drawn by hash, of another component."""
    pick = F.struct(F.xxhash64("id", F.lit(salt)).alias("draw"), F.col("component").alias("component"), F.col("id").alias("id"))
    groups = members.groupBy("key").agg(F.min(pick).alias("low"), F.max(pick).alias("high"), F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("size")).filter("least <> most").drop("least", "most")
    seen = join_groups(members, groups, "key", "size", total)
    other = F.when(F.col("low.component") != F.col("component"), F.col("low")).when(F.col("high.component") != F.col("component"), F.col("high"))
    best = seen.select("id", other.alias("other")).filter("other IS NOT NULL").groupBy("id").agg(F.min("other").alias("other"))
    return best.select(F.least("id", "other.id").alias("b"), F.greatest("id", "other.id").alias("a")).distinct()


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    shared = int((y[at] == x).sum())
    return DENOMINATOR * shared >= NUMERATOR * (len(x) + len(y) - shared)


def _compare(frame: pd.DataFrame) -> pd.DataFrame:
    """The links of one tile that join components: at most one fewer than it has rows.

    Signatures are compared first; full sets only for pairs within DISTANCE
    whose components are still apart.
    """
    frame = frame.sort_values(["block", "id"])
    symbols = np.frombuffer(b"".join(frame["signature"]), "<u2").reshape(-1, SYMBOLS)
    sets = [np.frombuffer(x, np.uint64) for x in frame["found"]]
    sizes = np.array([len(x) for x in sets])
    ids, block, component = frame["id"].to_numpy(), frame["block"].to_numpy(), frame["component"].to_numpy()
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while c in above:
            c = above[c]
        return c

    across = block[0] != block[-1]  # a tile of two blocks: pairs inside one belong to that block's own tile
    border = int(np.searchsorted(block, block[-1])) if across else 0
    out = []
    for i in range(border if across else len(ids) - 1):
        at = np.arange(border if across else i + 1, len(ids))
        low, high = np.minimum(sizes[at], sizes[i]), np.maximum(sizes[at], sizes[i])
        at = at[(component[at] != component[i]) & (DENOMINATOR * low >= NUMERATOR * high)]
        at = at[(symbols[at] != symbols[i]).sum(axis=1) <= DISTANCE]
        for j in at:
            one, two = top(component[i]), top(component[j])
            if one != two and _similar(sets[i], sets[j]):
                above[max(one, two)] = min(one, two)
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _tiles(members: DataFrame, mixed: DataFrame, classes: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """Links between the components of mixed groups, found exhaustively.

    Mixed groups of one hub form one cluster: what shares a key with the hub,
    and no chain from group to group, however far those reach.  A cluster's
    pairs are compared in tiles of two blocks of about TILE classes and at most
    about TILE_BYTES of sets, so a class is sent once for each block of its
    clusters and not once for each key or pair.
    """
    rows = join_groups(members, mixed, "key", "size", total).select("hub", "id", "component").distinct()
    rows = stored(rows.join(classes.select("id", "signature", "n_shingles"), "id"), "near-clusters")
    sizes = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.sum(8 * F.col("n_shingles")).alias("bytes"))
    rows = join_groups(rows, sizes, "hub", "size", rows.count())
    rows = rows.withColumn("blocks", F.ceil(F.greatest(F.col("size") / F.lit(TILE), F.col("bytes") / F.lit(TILE_BYTES))).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.join(sets.hint("merge"), "id")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("hub", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "id", "component", "block", "signature", "found")
    return rows.groupBy("hub", "one", "two").applyInPandas(_compare, "a long, b long")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component) of the classes that have a link, for classes (id, signature)."""
    ship(docs.sparkSession)
    keys = key_rows(classes)
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    total = classes.count() * len(KEYS)
    members = stored(join_groups(keys, groups, "key", "size", total).select("key", "id"), "near-members")
    ids = stored(members.select("id").distinct(), "near-ids")
    count = ids.count()
    if not count:
        return docs.sparkSession.createDataFrame([], "id long, component long")
    edges, labels = None, None
    with FullSets(docs, ids, count) as sets:
        for draw in range(ROUNDS + 1):
            now = stored(_labelled(members, labels), "near-labelled")
            if draw < ROUNDS:
                found = confirmed(_drawn(now, total, draw), sets)
            else:
                mixed = stored(_mixed(now), "near-mixed")
                if mixed.isEmpty():
                    break
                found = _tiles(now, mixed, classes, sets, total)
            found = stored(found, "near-links")
            discard(now)
            if found.isEmpty():
                continue
            edges = found if edges is None else edges.union(found)
            labels = components(edges)
    discard(members, ids)
    return labels if labels is not None else docs.sparkSession.createDataFrame([], "id long, component long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    base = stored(signatures(docs), "near-signatures")
    named = base.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(named.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "near-classes")
    labels = links(docs, classes)
    known = stored(classes.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"), "size"), "near-components")
    discard(classes)
    linked = join_groups(named.select("doc_id", "n_shingles", "digest"), known, "digest", "size", base.count())
    alone = base.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
