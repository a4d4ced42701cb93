"""SimHash near-duplicates with BK-trees.

Fingerprints of 64 bits come from an Arrow function. Every pair of distinct
fingerprints within two bits agrees on at least two of its four 16-bit blocks,
so each fingerprint is routed to the six shards named by a pair of block
values. Each shard holds a BK-tree: children keyed by their integer Hamming
distance to the parent; a probe follows only edges d-2..d+2. Trees travel with
their shard through one shuffle and are not sent to every task: probing all
trees with all fingerprints costs their product, and the shards lose no pair.
A shard with more fingerprints than SHARD_MOST is split again by the thirds of
its other 32 bits, of which one agrees in every pair within two bits, so the
split loses nothing either. A shard answers with spanning links, never with all pairs:
each local component becomes a tree of at most FAN children a node, so that no
fingerprint is a hub of the links, and components are few steps deep.

Rows: null and empty text get fingerprint zero, linked like any other.
Repeated rows share their fingerprint and so their component. A null doc_id
counts as larger than any other. Empty tables give empty tables.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, long_id, stored, table, utf8_rows

RADIUS = 2
SHARD_MOST = 4096
FAN = 8
SALTS = 16
CHUNK = 1 << 15
NO_ID = (1 << 63) - 1


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one text's UTF-8 bytes."""
    from xxhash import xxh64_digest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < 3:
        return int.from_bytes(xxh64_digest(b" ".join(words), 42), "big")
    n = len(words) - 2
    votes = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        end = min(n, at + CHUNK)
        grams = map(b" ".join, zip(words[at:end], words[at + 1 : end + 1], words[at + 2 : end + 2]))
        raw = np.frombuffer(b"".join([xxh64_digest(g, 42) for g in grams]), np.uint8)
        votes += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def of_hashes(own: np.ndarray) -> int:
    """The fingerprint of a set of 64-bit hashes; zero if it is empty."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(own), CHUNK):
        raw = own[at : at + CHUNK].astype(">u8").view(np.uint8)
        votes += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(own)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (a signed long) for each row."""

    def work(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in utf8_rows(batch.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    text = docs["text"].cast("string")
    return docs.select(long_id(docs).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        work, "doc_id long, text_hash long, fp long"
    )


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self._root: tuple[int, dict] | None = None

    def add_and_find(self, value: int, radius: int) -> list[int]:
        """Inserts a value not held yet; returns held values within the radius."""
        if self._root is None:
            self._root = (value, {})
            return []
        found, todo = [], [self._root]
        while todo:
            held, children = todo.pop()
            d = (held ^ value).bit_count()
            if d <= radius:
                found.append(held)
            for near in range(max(1, d - radius), d + radius + 1):
                child = children.get(near)
                if child is not None:
                    todo.append(child)
        at = self._root
        while True:
            d = (at[0] ^ value).bit_count()
            child = at[1].get(d)
            if child is None:
                at[1][d] = (value, {})
                return found
            at = child


def spanning_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that tie each component of one shard's values: member k of a
    component, in order, to its member (k - 1) // FAN."""
    tree, parent = BKTree(), {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v in values:
        parent[v] = v
        for other in tree.add_and_find(v, radius):
            a, b = top(v), top(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    members: dict[int, list[int]] = {}
    for v in values:
        members.setdefault(top(v), []).append(v)
    return [(own[k], own[(k - 1) // FAN]) for own in members.values() for k in range(1, len(own))]


def _sharded(distinct: DataFrame) -> DataFrame:
    """shard, fp: each fingerprint in its six shards, hot shards split exactly."""
    blocks = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]

    def entry(k, a, b):
        c, d = (x for x in range(4) if x not in (a, b))
        return F.struct(
            (F.lit(k << 32).cast("long") + F.shiftleft(blocks[a], 16) + blocks[b]).alias("key"),
            (F.shiftleft(blocks[c], 16) + blocks[d]).alias("rest"),
        )

    rows = distinct.select("fp", F.explode(F.array(*(entry(k, a, b) for k, (a, b) in enumerate(pairs)))).alias("e")).select(
        "fp", "e.key", "e.rest"
    )
    hot = rows.groupBy("key").count().where(F.col("count") > SHARD_MOST).select("key", F.lit(True).alias("hot"))
    thirds = F.array(
        F.concat_ws(":", F.lit("a"), F.col("rest").bitwiseAND(0x7FF)),
        F.concat_ws(":", F.lit("b"), F.shiftright("rest", 11).bitwiseAND(0x7FF)),
        F.concat_ws(":", F.lit("c"), F.shiftright("rest", 22)),
    )
    return rows.join(hot, "key", "left").select(
        "fp", "key", F.explode(F.when(F.col("hot"), thirds).otherwise(F.array(F.lit("")))).alias("part")
    )


def links(distinct: DataFrame) -> DataFrame:
    """a, b: spanning links among distinct fingerprints within RADIUS bits."""

    def work(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist())

        out: set[tuple[int, int]] = set()
        for _, group in groupby(rows(), key=lambda r: r[:2]):
            values = [fp & 0xFFFFFFFFFFFFFFFF for _, _, fp in group]
            if len(values) > 1:
                out.update(spanning_links(values))
            if len(out) > 50_000:
                yield _pairs(out)
                out = set()
        if out:
            yield _pairs(out)

    shards = _sharded(distinct).repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return shards.select("fp", "key", "part").mapInArrow(work, "a long, b long").distinct()


def _pairs(pairs) -> pa.RecordBatch:
    both = np.array(sorted(pairs), np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the connected component of each node of ``edges`` (a, b).

    Each round takes the least label over a node's neighbours and then follows
    labels (pointer jumping); rounds end when no label changes. Each round is
    written to the shared folder. A component's many nodes look up its label
    under SALTS keys.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(seen, labels.node == seen.a).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        up = step.join(step.select(F.col("root").alias("used")).distinct(), step["node"] == F.col("used"), "left_semi").select(F.col("node").alias("key"), F.col("root").alias("up"))
        new = stored(_looked_up(step, "root", "node", up).select("node", "was", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        if new.where("was <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def _looked_up(rows: DataFrame, column: str, spread: str, values: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``values`` (key, and others) on ``column``, of
    which one value may stand in many rows: keys are salted by ``spread``."""
    salted = values.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    own = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return own.join(salted, (own[column] == salted["key"]) & (own["__salt"] == salted["salt"]), "left").drop("key", "salt", "__salt")


def with_components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp and others) with component_id, the least doc_id of
    the rows whose fp ``edges`` (a, b) tie together, and group_key, which tells
    components apart even where their least doc_ids are alike or null."""
    distinct = rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"))
    own = distinct.select(F.col("fp").alias("key"), F.col("least").alias("component"), F.col("fp").alias("group_key"))
    if not edges.isEmpty():
        label = components(edges)
        tied = distinct.join(label, distinct.fp == label.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
        of_root = tied.groupBy("root").agg(F.min("least").alias("component")).select(F.col("root").alias("key"), "component")
        own = _looked_up(tied, "root", "fp", of_root).select(F.col("fp").alias("key"), "component", F.col("root").alias("group_key"))
    found = rows.join(own, rows["fp"] == own["key"]).drop("key")
    return found.withColumn("component_id", F.nullif(F.col("component"), F.lit(NO_ID))).drop("component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id, group_key for each row of
    ``docs``."""
    rows = stored(fingerprints(docs), "fingerprints")
    found = with_components(rows, stored(links(rows.select("fp").distinct()), "links"))
    return found.select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_key")


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each component of ``found`` (by default their
    near duplicates): the one of the least (doc_id, hash of the text), a null
    doc_id last; of rows equal in both, any one.

    Only rows of one component displace one another: documents that share a
    doc_id, or have none, but not a component all stay."""
    found = near_duplicates(docs) if found is None else found
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("text_hash", F.lit(0)).alias("h"))).alias("k")
    of = found.groupBy("group_key").agg(least).select(F.col("k.id").alias("__id"), F.col("k.h").alias("__h")).distinct()
    own = docs.select("*", F.coalesce(long_id(docs), F.lit(NO_ID)).alias("__own_id"), F.xxhash64(docs["text"].cast("string")).alias("__own_h"))
    kept = own.join(of, (F.col("__own_id") == F.col("__id")) & (F.col("__own_h") == F.col("__h")), "left_semi")
    return kept.dropDuplicates(["__own_id", "__own_h"]).select(*docs.columns)


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
