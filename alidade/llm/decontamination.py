"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a shard is a run of documents of about
SHARD_BYTES of text and is stored as one row that holds, for every term, the
sorted positions of its postings (all documents of the shard laid end to end
with one empty place between them). Storing it by document means that no
posting crosses the network and no frequent term meets in one task.

A search takes the test texts in blocks of BLOCK_BYTES at most and goes over
all shards with each block: for a window it starts from its rarest term's list,
shifts it by the term's offset and intersects it with the next rarest, until
the whole phrase stands (exact), or looks for terms near one another
(proximity). A proximity match is NEAR_SHARE of a window's distinct terms within
fewer than NEAR_SPAN places of one of its rarest terms, or the item's NEAR_TERMS
rarest terms that occur at all near one another. So many of a window's rarest
terms are gone through that each run of NEAR_SPAN words with the share holds
one of them, so none is missed.

Words: A-Z lower-cased, runs of [0-9a-z] and non-ASCII characters. A window is
10 words in a row; an item of fewer words, but not none, is one window.

Rows: null and empty text has no words. Repeated documents are answered each;
repeated items count once; a null item_id counts as "". Empty tables give
empty (documents) or clean (benchmark) results. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, slices, stored, table, utf8_rows

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
NEAR_TERMS = 3
NEAR_SPAN = 20
NEAR_SHARE = (4, 5)

#: Word bytes stay (A-Z lower-cased), the rest become spaces; bytes from 0x80 on belong to words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Shard:
    """Postings of a run of documents."""

    starts: np.ndarray  # of each document, in places
    sizes: np.ndarray  # words of each document
    terms: pa.Array  # binary
    offsets: np.ndarray  # term k has positions[offsets[k]:offsets[k + 1]]
    positions: np.ndarray

    @classmethod
    def build(cls, texts: list[bytes], vocabulary: dict[bytes, int] | None = None) -> Shard:
        """The postings of all terms, or of a vocabulary's."""
        own: dict[bytes, int] = {} if vocabulary is None else vocabulary
        ids, sizes = [], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            if vocabulary is None:
                for w in set(words).difference(own):
                    own[w] = len(own)
                ids += map(own.__getitem__, words)
            else:
                ids += map(own.get, words, repeat(-1))
            ids.append(-1)
        flat, sizes_ = np.array(ids, np.int32), np.array(sizes, np.int64)
        at = np.flatnonzero(flat >= 0)
        order = np.argsort(flat[at], kind="stable")
        counts = np.bincount(flat[at], minlength=len(own)) if len(own) else np.empty(0, np.int64)
        held = np.flatnonzero(counts)
        names = pa.array(list(own), pa.binary()).take(pa.array(held))
        return cls(_starts(sizes_), sizes_, names, np.concatenate([[0], np.cumsum(counts[held])]), at[order].astype(np.int32))

    def row(self, shard: str, doc_ids: list) -> pa.RecordBatch:
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [pa.array(doc_ids, pa.int64()), pa.array(self.sizes, pa.int64()), self.terms, pa.array(np.diff(self.offsets), pa.int64()), pa.array(self.positions, pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([shard]), *map(one, columns)], schema=_INDEX_ARROW)

    @classmethod
    def of_row(cls, sizes: pa.Array, terms: pa.Array, counts: pa.Array, positions: pa.Array) -> Shard:
        n = sizes.to_numpy(zero_copy_only=False)
        return cls(_starts(n), n, terms, np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))]), positions.to_numpy(zero_copy_only=False))

    def lists_of(self, known: pa.Array) -> dict[int, np.ndarray]:
        """The positions of the known terms, by their places among these."""
        place = pc.fill_null(pc.index_in(self.terms, known), -1).to_numpy(zero_copy_only=False)
        return {int(place[k]): self.positions[self.offsets[k] : self.offsets[k + 1]] for k in np.flatnonzero(place >= 0)}


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)


def _shards(batch: pa.RecordBatch):
    """(name, shard) of the rows of (shard, sizes, terms, counts, positions)."""
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns[1:]]
    for k, name in enumerate(batch.column(0).to_pylist()):
        yield name, Shard.of_row(*(c[k].values for c in lists))


def _loose(order: list[int], terms: list[int]) -> tuple[list[int], list[tuple[frozenset[int], frozenset[int], int]]]:
    """An item's terms, and of each window its terms, the rarest of them of
    which any run with enough terms holds one, and how many are enough."""
    rank, out = {t: k for k, t in enumerate(order)}, []
    for own in {frozenset(terms[a : a + WINDOW]) for a in range(max(1, len(terms) - WINDOW + 1))}:
        need = -(-len(own) * NEAR_SHARE[0] // NEAR_SHARE[1])
        out.append((own, frozenset(sorted(own, key=rank.get)[: len(own) - need + 1]), need))
    return order, out


class Queries:
    """One block of test texts: its terms, distinct windows and items."""

    def __init__(self, items: list[tuple[str, bytes]], rarity: dict[bytes, int] | None = None):
        self.ids: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.items)}
        self.near: list[tuple[int, tuple[int, ...]]] = []
        self.loose: list[tuple[int, list[int], list[tuple[frozenset[int], frozenset[int], int]]]] = []
        for name, text in items:
            words = words_of(text)
            terms = [self.ids.setdefault(w, len(self.ids)) for w in words]
            for a in range(max(1, len(terms) - WINDOW + 1) if terms else 0):
                seen.setdefault(tuple(terms[a : a + WINDOW]), set()).add(number[name])
            if rarity is not None and terms:
                order = sorted(set(words), key=lambda w: (rarity.get(w, 0), w))
                rare = [w for w in order if rarity.get(w, 0)][:NEAR_TERMS]
                if len(rare) == min(NEAR_TERMS, len(order)):
                    self.near.append((number[name], tuple(self.ids[w] for w in rare)))
                self.loose.append((number[name], *_loose([self.ids[w] for w in order], terms)))
        self.terms = pa.array(list(self.ids), pa.binary())
        self.windows = list(seen)
        self.owners = [sorted(seen[w]) for w in self.windows]
        self.table = np.full((len(self.windows), WINDOW), -1, np.int32)
        for k, w in enumerate(self.windows):
            self.table[k, : len(w)] = w

    def search(self, shard: Shard) -> tuple[np.ndarray, dict[int, set[int]], dict[int, set[int]]]:
        """Which places are hit; by document the items found, and those found near."""
        places = int(shard.starts[-1] + shard.sizes[-1] + 1) if len(shard.sizes) else 0
        change = np.zeros(places + 1, np.int32)
        found: dict[int, set[int]] = {}
        near: dict[int, set[int]] = {}
        if not places or not self.windows:
            return change[:places] > 0, found, near
        lists = shard.lists_of(self.terms)
        count = np.zeros(len(self.ids) + 1, np.int64)
        at = np.full(places, -1, np.int32)
        for q, own in lists.items():
            count[q] = len(own)
            at[own] = q
        count[-1] = 1 << 40  # a place past a short window's end
        of = count[self.table]
        for k in np.flatnonzero(of.min(axis=1) > 0):
            window = self.windows[k]
            rarest = np.argsort(of[k, : len(window)], kind="stable")
            begin = lists[window[rarest[0]]].astype(np.int64) - rarest[0]
            begin = begin[begin >= 0]
            for offset in rarest[1:]:
                begin = _met(begin, lists[window[offset]], offset)
                if not len(begin):
                    break
            if len(begin):
                np.add.at(change, begin, 1)
                np.add.at(change, begin + len(window), -1)
                for doc in np.unique(np.searchsorted(shard.starts, begin, "right") - 1).tolist():
                    found.setdefault(doc, set()).update(self.owners[k])
        for item, terms in self.near:
            if all(t in lists for t in terms):
                first, ok = lists[terms[0]], None
                doc = np.searchsorted(shard.starts, first, "right") - 1
                ok = np.ones(len(first), bool)
                for t in terms[1:]:
                    other = lists[t]
                    j = np.searchsorted(other, first)
                    left, right = other[np.maximum(j - 1, 0)], other[np.minimum(j, len(other) - 1)]
                    low, high = shard.starts[doc], shard.starts[doc] + shard.sizes[doc]
                    ok &= sum((np.abs(x - first) < NEAR_SPAN) & (x >= low) & (x < high) for x in (left, right)).astype(bool)
                for d in np.unique(doc[ok]).tolist():
                    near.setdefault(d, set()).add(item)
        for item, terms, windows in self.loose:
            own, least = [lists[t] for t in terms if t in lists], min(need for _, _, need in windows)
            if len(own) < least:
                continue
            p = np.sort(np.concatenate(own))
            tight = np.flatnonzero(p[least - 1 :] - p[: len(p) - least + 1] < 2 * NEAR_SPAN - 1)
            if not len(tight):
                continue
            mark = np.zeros(len(p) + 1, np.int64)
            np.add.at(mark, tight, 1)
            np.add.at(mark, tight + least, -1)
            c = p[np.cumsum(mark[:-1]) > 0]
            of_term: dict[int, list] = {}
            for all_, rare, need in windows:
                for t in rare:
                    of_term.setdefault(t, []).append((all_, need))
            centre = np.zeros(len(self.ids), bool)
            centre[list(of_term)] = True
            c = c[centre[at[c]]]
            doc = np.searchsorted(shard.starts, c, "right") - 1
            low = np.searchsorted(p, np.maximum(c - NEAR_SPAN + 1, shard.starts[doc]))
            high = np.searchsorted(p, np.minimum(c + NEAR_SPAN, shard.starts[doc] + shard.sizes[doc]))
            enough = high - low >= least
            for x, d, a, b in zip(at[c[enough]].tolist(), doc[enough].tolist(), low[enough].tolist(), high[enough].tolist()):
                if item not in near.get(d, ()):
                    held = set(at[p[a:b]].tolist())
                    if len(held) >= least and any(len(all_ & held) >= need for all_, need in of_term[x]):
                        near.setdefault(d, set()).add(item)
        return np.cumsum(change[:places]) > 0, found, near


def _met(begin: np.ndarray, other: np.ndarray, offset: int) -> np.ndarray:
    """The places of ``begin`` with one of the sorted ``other`` at the offset."""
    want = begin + offset
    j = np.minimum(np.searchsorted(other, want), len(other) - 1)
    return begin[other[j] == want]


_INDEX = "shard string, doc_ids array<bigint>, sizes array<bigint>, terms array<binary>, counts array<bigint>, positions array<int>"
_INDEX_ARROW = pa.schema([("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32()))])


def build_index(docs: DataFrame) -> DataFrame:
    """Stores the positional index of all terms of ``docs``."""

    def work(batches):
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), list(utf8_rows(batch.column(1)))
            for a, b in slices([len(t) for t in texts], SHARD_BYTES):
                yield Shard.build(texts[a:b]).row(f"{part}:{n}", ids[a:b])
                n += 1

    return stored(docs.select(long_id(docs).alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(work, _INDEX), "index")


def frequencies(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often the terms, of one block of test texts, occur in the index."""
    shared = index.sparkSession.sparkContext.broadcast(pa.array(sorted(terms), pa.binary()))  # one block

    def work(batches):
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for names, counts in zip(batch.column(0), batch.column(1)):
                place = pc.fill_null(pc.index_in(names.values, known), len(known)).to_numpy(zero_copy_only=False)
                total += np.bincount(place, counts.values.to_numpy(zero_copy_only=False), len(known) + 1).astype(np.int64)
        held = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([known.take(pa.array(held)), pa.array(total[held], pa.int64())], ["term", "n"])

    if not terms:
        return {}
    counts = index.select("terms", "counts").mapInArrow(work, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in counts.collect()}  # at most the block's terms


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """item, text, block: the test texts dealt to blocks, and how many there are."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BLOCK_BYTES))
    return rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def _block(rows: DataFrame, k: int) -> list[tuple[str, bytes]]:
    return [(r[0], r[1].encode()) for r in rows.where(F.col("block") == k).select("item", "text").collect()]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def search(index: DataFrame, items: DataFrame) -> DataFrame:
    """shard, ordinal, starts, ends, items, near: of documents with a match, and
    of each block, the runs of hit words (from the document's first, end
    exclusive), the items whose phrases occur and those with a proximity match."""
    spark, (rows, n) = index.sparkSession, _blocks(items)
    out = None
    for k in range(n):
        block = _block(rows, k)
        rarity = frequencies(index, {w for _, t in block for w in words_of(t)})
        shared = spark.sparkContext.broadcast((block, rarity))  # one block

        def work(batches):
            queries = Queries(*shared.value)
            for batch in batches:
                for name_, shard in _shards(batch):
                    hit, found, near = queries.search(shard)
                    out = []
                    for d in sorted({*found, *near}):
                        a = shard.starts[d]
                        starts, ends = _runs(hit[a : a + shard.sizes[d]])
                        name = lambda ks: [queries.items[x] for x in sorted(ks)]
                        out.append({"shard": name_, "ordinal": d, "starts": starts, "ends": ends, "items": name(found.get(d, ())), "near": name(near.get(d, ()))})
                    if out:
                        yield pa.RecordBatch.from_pylist(out, _HITS_ARROW)

        own = index.select("shard", "sizes", "terms", "counts", "positions").mapInArrow(work, _HITS)
        out = own if out is None else out.unionAll(own)
    if n == 1:
        return out
    place = F.array_distinct(F.flatten(F.transform(F.arrays_zip("starts", "ends"), lambda r: F.sequence(r["starts"], r["ends"] - 1))))
    gathered = out.select("shard", "ordinal", place.alias("places"), "items", "near").groupBy("shard", "ordinal").agg(
        *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("places", "items", "near"))
    )
    return gathered.select("shard", "ordinal", F.col("places").alias("starts"), F.transform("places", lambda p: p + 1).alias("ends"), "items", "near")


_HITS = "shard string, ordinal bigint, starts array<bigint>, ends array<bigint>, items array<string>, near array<string>"
_HITS_ARROW = pa.schema([("shard", pa.string()), ("ordinal", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, starts, ends, items, near for each row of ``docs``."""
    index = build_index(docs)
    hits = stored(search(index, items), "hits")
    every = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("ordinal", "d"))
    return every.join(hits, (every["shard"] == hits["shard"]) & (every["ordinal"] == hits["ordinal"]), "left").select(
        F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").alias("n_words"), *(F.coalesce(c, F.array()).alias(c) for c in ("starts", "ends", "items", "near"))
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of ``items``: each
    Arrow batch is indexed in shards and searched where it is read."""
    rows, n = _blocks(items)
    for k in range(n):
        shared = docs.sparkSession.sparkContext.broadcast(_block(rows, k))
        at = docs.columns.index("text")

        def work(batches, shared=shared, at=at):
            queries = Queries(shared.value)
            for batch in batches:
                texts, keep = list(utf8_rows(batch.column(at).cast(pa.string()))), np.ones(batch.num_rows, bool)
                for a, b in slices([len(t) for t in texts], SHARD_BYTES):
                    _, found, _ = queries.search(Shard.build(texts[a:b], queries.ids))
                    keep[[a + d for d in found]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"),
    )
