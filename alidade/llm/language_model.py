"""Masked pseudo-likelihood scores from a bidirectional window network.

Each token is predicted from the REACH tokens on either side: their vectors,
one table for each place in the window, are summed, squashed and fed to a
two-level softmax (class, then word within the class). A document's score is
the sum of its tokens' conditional log-probabilities.

1. Words are counted over the whole corpus. The VOCABULARY most frequent have
   ids; the others share HASHED bucket ids, so the network's size is fixed. A
   word of a bucket scores the bucket's probability times the word's share of
   the bucket in the full counts. The shares of the most frequent KNOWN of them
   are added up where the text is encoded, one join by word looks up all others:
   what is gathered grows with the corpus, and no two words are told alike.
2. Texts are encoded once and stored as ids. Slices of about SLICE bytes are
   split by Arrow, and each different word of a slice is looked up once.
3. Documents are dealt by a hash of their text to groups of about GROUP_BYTES.
   In each of ROUNDS rounds a group masks one of STEP tokens of each document
   (other ones each round, by the document's hash and the place), trains a copy
   of the network on them in numpy, and sends its change by blocks; blocks are
   summed under salts and then whole, and the average, weighted by masked
   tokens, is the next network. So scores do not depend on how rows lie in
   partitions or batches. Over the rounds every token is predicted once in
   training, and again in scoring. The network begins as the unigram model.

Rows: null and empty text has no tokens and score 0. Repeated rows are scored
alike; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import ctypes
import glob
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, long_id, slices, stored, table  # noqa: F401 (LOWER: for tests)

CLASSES = 64
WORDS = 64
HASHED = 256
VOCABULARY = CLASSES * WORDS - HASHED
WIDTH = 24
REACH = 2
STEP = 2
#: As many rounds as parts, so that training predicts every token once.
ROUNDS = STEP
RATE = 0.3
BATCH = 4096
CHUNK = 16384
BLOCKS = 32
GROUP_BYTES = 16 << 20
SALT_GROUPS = 64
HELD_WORDS = 400_000
#: Texts are split into words by so many bytes at once; a longer text alone.
SLICE = 4 << 20
#: At most so many words' shares go to all tasks, 16 bytes each; the join has the rest.
KNOWN = 200_000
_SIZE = CLASSES * WORDS
_SHARED = HASHED // CLASSES


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words (binary) of some texts, the place among them of each
    word as it stands, and where each text's words begin, with their end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = lists.flatten().dictionary_encode()
    words, codes, edges = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), lists.offsets.to_numpy()
    edges = edges - edges[0]
    nothing = pc.index(words, b"").as_py()
    if nothing >= 0:  # white space at a text's ends leaves empty words there
        keep = codes != nothing
        codes, edges = codes[keep], np.concatenate([[0], np.cumsum(keep)])[edges]
    return words, codes, edges


def text_slices(batch: pa.RecordBatch, column: int):
    """Parts of a batch whose texts hold about SLICE bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in slices(sizes, SLICE):
        yield batch.slice(a, b - a)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n over all documents; partitions send sums."""

    def work(batches):
        held: list[pa.Table] = []

        def added():
            sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table({"word": sums["word"], "n": sums["n_sum"]})

        for batch in batches:
            for part in text_slices(batch, 0):
                words, codes, _ = split_words(part.column(0))
                n = np.bincount(codes, minlength=len(words))
                held.append(pa.table({"word": words, "n": pa.array(n, pa.int64())}).filter(pa.array(n > 0)))
                if sum(map(len, held)) > HELD_WORDS:
                    held = [added()]
                    if len(held[0]) > HELD_WORDS // 2:
                        yield from held[0].to_batches(50_000)
                        held = []
        if held:
            yield from added().to_batches(50_000)

    return docs.select(docs["text"].cast("string").alias("text")).mapInArrow(work, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def bucket_id(bucket):
    """The id that a bucket's words share: one of the last of each class."""
    return (bucket % CLASSES) * WORDS + WORDS - _SHARED + bucket // CLASSES


def vocabulary(counts: DataFrame) -> dict[bytes, int]:
    """Ids of the most frequent words; VOCABULARY rows reach the driver.

    A histogram of the counts gives a threshold first, so that tasks hold few
    rows. Words take turns over the classes: each has frequent and rare ones."""
    step = F.floor(8 * F.log2("n")).cast("long")
    steps, threshold, n = sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True), 0, 0
    for s, many in steps:
        threshold, n = s, n + many
        if n >= VOCABULARY:
            break
    top = counts.where(step >= threshold).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    return {bytes(r["word"]): (k % CLASSES) * WORDS + k // CLASSES for k, r in enumerate(top)}


class Network:
    """inputs: place x (id or end) x width; classes and words: the outputs,
    whose last column is the bias."""

    SHAPES = ((2 * REACH, _SIZE + 1, WIDTH), (CLASSES, WIDTH + 1), (CLASSES, WORDS, WIDTH + 1))

    def __init__(self, flat: np.ndarray | None = None, often: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(7)
            parts = [rng.normal(0, 0.1, s).astype(np.float32) for s in self.SHAPES]
            often = np.ones((CLASSES, WORDS)) if often is None else often.reshape(CLASSES, WORDS) + 0.1
            parts[1][:, -1] = np.log(often.sum(1) / often.sum())
            parts[2][:, :, -1] = np.log(often / often.sum(1, keepdims=True))
        else:
            ends = np.cumsum([int(np.prod(s)) for s in self.SHAPES])
            parts = [p.reshape(s).copy() for p, s in zip(np.split(flat.astype(np.float32), ends[:-1]), self.SHAPES)]
        self.inputs, self.classes, self.words = parts

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inputs.ravel(), self.classes.ravel(), self.words.ravel()])

    def _hidden(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden values, and the rows of all inputs they come from, by place."""
        around = np.stack([ids[at + o] for o in (*range(-REACH, 0), *range(1, REACH + 1))])
        around[around < 0] = _SIZE
        around += np.arange(2 * REACH, dtype=around.dtype)[:, None] * (_SIZE + 1)
        rows = self.inputs.reshape(-1, WIDTH)
        total = np.take(rows, around[0], axis=0)
        for near in around[1:]:
            total += np.take(rows, near, axis=0)
        hidden = np.ones((len(at), WIDTH + 1), np.float32)
        np.tanh(total, out=hidden[:, :-1])
        return hidden, around

    def _by_class(self, hidden: np.ndarray, cls: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """For rows in order of class: each class met with its first row and
        its end, and what its words get."""
        edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        met = [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        out = np.empty((len(cls), WORDS), np.float32)
        for c, a, b in met:
            np.matmul(hidden[a:b], self.words[c].T, out=out[a:b])
        return met, out

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.float32)
        for a in range(0, len(at), CHUNK):
            here = at[a : a + CHUNK]
            order = _class_order(ids[here])
            here = here[order]
            hidden, _ = self._hidden(ids, here)
            cls, word = np.divmod(ids[here], WORDS)
            own = _log_softmax_at(hidden @ self.classes.T, cls)
            own += _log_softmax_at(self._by_class(hidden, cls)[1], word)
            out[a + order] = own
        return out

    def learn(self, ids: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One pass of gradient steps over the masked places."""
        rows = self.inputs.reshape(-1, WIDTH)
        for a in range(0, len(at), BATCH):
            here = at[a : a + BATCH]
            here, n = here[_class_order(ids[here])], len(here)
            hidden, around = self._hidden(ids, here)
            cls, word = np.divmod(ids[here], WORDS)
            p = _softmax(hidden @ self.classes.T)
            p[np.arange(n), cls] -= 1
            back = p @ self.classes[:, :-1]
            self.classes -= rate * np.clip(p.T @ hidden / np.sqrt(n), -1, 1) / 2
            met, z = self._by_class(hidden, cls)
            q, below = _softmax(z), np.empty_like(back)
            q[np.arange(n), word] -= 1
            change = np.zeros_like(self.words)
            for c, a_, b_ in met:
                np.matmul(q[a_:b_], self.words[c, :, :-1], out=below[a_:b_])
                np.matmul(q[a_:b_].T, hidden[a_:b_], out=change[c])
                change[c] *= 1 / math.sqrt(b_ - a_)
            np.clip(change, -1, 1, out=change)
            change *= rate / 2
            self.words -= change
            back += below
            grad = np.clip(back * (1 - hidden[:, :-1] ** 2), -1, 1) * (rate / 2)
            keys = around.ravel().astype(np.uint16)  # fewer rows than 2^16: sorted by digits
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            # two values as one complex number: half as many sums to begin
            sums = np.add.reduceat(np.take(grad, order % n, axis=0).view(np.complex64), firsts, axis=0).view(np.float32)
            rows[keys[firsts]] -= sums


def _class_order(ids: np.ndarray) -> np.ndarray:
    return np.argsort((ids // WORDS).astype(np.int16), kind="stable")


def one_thread() -> None:
    """Keeps numpy's linear algebra to this task's core: its products are small
    and a second thread only waits."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            call = getattr(ctypes.CDLL(path), name, None)
            if call is not None:
                call(1)


_ONES = np.ones(max(CLASSES, WORDS), np.float32)


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of z, whose rows may be shifted in place, and their
    sums: shifted by the largest of all, and where that makes a row vanish, by
    the row's own largest."""
    z -= z.max(initial=-np.inf)
    e = np.exp(z)
    total = e @ _ONES[: z.shape[1]]
    low = np.flatnonzero(total < 1e-20)
    if len(low):
        z[low] -= z[low].max(1, keepdims=True)
        e[low] = np.exp(z[low])
        total[low] = e[low].sum(1)
    return e, total


def _softmax(z: np.ndarray) -> np.ndarray:
    e, total = _exponentials(z)
    e /= total[:, None]
    return e


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    _, total = _exponentials(z)
    return z[np.arange(len(z)), at] - np.log(total)


def encoded(docs: DataFrame, words: dict[bytes, int], known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, h (of the text), ids (two bytes each), told (the sum of the
    shares of its words in ``known``: sorted hashes, shares), rare (hashes of
    the other words without their own id, each as often as it stands) for each
    row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((words, *known))  # VOCABULARY words, KNOWN hashes

    def work(batches):
        from xxhash import xxh64_intdigest

        words, hashes, shares = shared.value
        own, own_ids = pa.array(list(words), pa.binary()), np.array(list(words.values()), np.uint16)
        for batch in batches:
            for part in text_slices(batch, 2):
                found, codes, edges = split_words(part.column(2))
                at = pc.fill_null(pc.index_in(found, value_set=own), -1).to_numpy()
                other = np.flatnonzero(at < 0)
                texts = found.take(pa.array(other)).to_numpy(zero_copy_only=False)
                buckets = np.fromiter(map(zlib.crc32, texts), np.int64, len(texts)) % HASHED
                ids = np.empty(len(found), np.uint16)
                ids[at >= 0] = own_ids[at[at >= 0]]
                ids[other] = bucket_id(buckets)
                # of each word: its hash, whether its share is known, and that share
                digest, met, share = np.zeros(len(found), np.int64), np.zeros(len(found), bool), np.zeros(len(found))
                digest[other] = np.fromiter((xxh64_intdigest(w, 42) for w in texts), np.uint64, len(texts)).view(np.int64)
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, digest[other]), len(hashes) - 1)
                    met[other] = hashes[place] == digest[other]
                    share[other] = shares[place]
                rare = np.flatnonzero((at < 0)[codes])
                row, rare = np.repeat(np.arange(len(part)), np.diff(edges))[rare], codes[rare]
                known = met[rare]
                told = np.bincount(row[known], share[rare[known]], len(part))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=len(part)))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(ends), pa.array(digest[rare[~known]]))
                two = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(ids[codes])])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), two, pa.array(told, pa.float64()), rest], ["doc_id", "h", "ids", "told", "rare"])

    text = docs["text"].cast("string")
    rows = docs.select(long_id(docs).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, h bigint, ids binary, told double, rare array<bigint>")


def joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows with REACH ends (-1, the last input) around each, where
    each row begins, and its length."""
    own = [np.frombuffer(r, np.uint16) for r in rows]
    sizes = np.array([len(r) for r in own], np.int64)
    starts = np.cumsum(np.concatenate([[0], sizes[:-1] + REACH])) + REACH if len(own) else np.empty(0, np.int64)
    flat = np.full(int(sizes.sum()) + REACH * (len(own) + 1), -1, np.int32)
    for r, a in zip(own, starts):
        flat[a : a + len(r)] = r
    return flat, starts, sizes


def rounds(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The part of STEP that masks each place of documents with hashes ``h``."""
    x = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)) % np.uint64(STEP)


def masked(h: int, n: int, turn: int) -> np.ndarray:
    """The places of a document that a round masks."""
    return np.flatnonzero(rounds(np.array([h & (1 << 64) - 1], np.uint64), np.arange(n)) == turn % STEP)


def group_change(rows: list[tuple[int, bytes]], flat: np.ndarray, turn: int) -> tuple[int, np.ndarray]:
    """How many tokens a group masks, and its copy's change of the network."""
    net, n = Network(flat), 0
    rate = RATE / (1 + turn)
    begun: list[tuple[int, bytes]] = []

    def run():
        nonlocal n
        ids, _, sizes = joined([r for _, r in begun])
        hashes, before = np.array([h for h, _ in begun], np.int64), np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(before, sizes)
        at = np.flatnonzero(ids >= 0)[rounds(np.repeat(hashes, sizes), place) == turn % STEP]
        net.learn(ids, at, rate)
        n += len(at)
        begun.clear()

    held = 0
    for h, r in rows:
        begun.append((h, r))
        held += len(r) // 2
        if held >= BATCH * STEP * 8:
            run()
            held = 0
    if begun:
        run()
    return n, net.flat() - flat


def _average(groups: DataFrame, flat: np.ndarray, turn: int, n_groups: int) -> np.ndarray:
    """The next network's weights after one round over all documents."""
    shared = groups.sparkSession.sparkContext.broadcast(flat)  # fixed size
    edges = np.linspace(0, len(flat), BLOCKS + 1).astype(int)
    names = ["block", "salt", "n", "part"]

    def work(batches):
        from itertools import groupby

        one_thread()

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for g, own in groupby(rows(), key=lambda r: r[0]):
            n, change = group_change(((h, ids) for _, h, ids in own), shared.value, turn)
            if n:
                parts = [(change[a:b] * n).astype(np.float32).tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([g // SALT_GROUPS] * BLOCKS, pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array(parts, pa.binary())], names)

    def add(batches):
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, salt, n, part in zip(*(c.to_pylist() for c in batch.columns)):
                held = sums.setdefault((block, salt), [0, 0.0])
                held[0] += n
                held[1] = held[1] + np.frombuffer(part, np.float32).astype(np.float64)
        for (block, salt), (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([n], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names)

    schema = "block int, salt int, n bigint, part binary"
    sent = groups.select("g", "h", "ids").mapInArrow(work, schema)
    if n_groups > SALT_GROUPS:
        sent = sent.repartition("block", "salt").sortWithinPartitions("block", "salt", "n", "part").mapInArrow(add, schema).withColumn("salt", F.lit(0))
    rows = sent.withColumn("salt", F.lit(0)).repartition(BLOCKS, "block").sortWithinPartitions("block", "n", "part").mapInArrow(add, schema).collect()  # BLOCKS rows, one network
    out = flat.copy()
    for r in rows:
        out[edges[r["block"]] : edges[r["block"] + 1]] += np.frombuffer(bytes(r["part"]), np.float32) / r["n"]
    return out


class Model:
    """Word ids, the network's weights, the shares of the other words (known:
    hashes and shares; the rest: rare, share), and the log of a share for words
    never met."""

    def __init__(self, words: dict[bytes, int], flat: np.ndarray, known: tuple[np.ndarray, np.ndarray], shares: DataFrame, least: float):
        self.words, self.flat, self.known, self.shares, self.least = words, flat, known, shares, least


def _known(shares: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """Sorted hashes and shares of the KNOWN most frequent of ``shares`` (rare,
    share, n) or fewer, and the rows of the others. Which are known changes no
    score: the join finds the same share."""
    step = F.floor(8 * F.log2("n")).cast("long")
    least, many = None, 0
    for s, n in sorted(shares.groupBy(step.alias("s")).count().collect(), reverse=True):
        many += n
        if many > KNOWN:
            break
        least = s
    if least is None:
        return (np.empty(0, np.int64), np.empty(0)), shares
    rows = shares.where(step >= least).select("rare", "share").toArrow()  # KNOWN rows
    hashes, values = (rows.column(k).to_numpy() for k in range(2))
    order = np.argsort(hashes)
    return (hashes[order], values[order]), shares.where(step < least)


def _dealt(rows: DataFrame, n_groups: int) -> DataFrame:
    """g, h, ids: each group's documents together, in order of their hash."""
    g = F.pmod(F.xxhash64("h"), F.lit(n_groups)).cast("int")
    return rows.select(g.alias("g"), "h", "ids").repartition(n_groups, "g").sortWithinPartitions("g", "h", "ids")


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the encoded rows of ``docs``."""
    counts = stored(word_counts(docs), "word-counts")
    words = vocabulary(counts)
    bucket = F.pmod(F.crc32("word"), F.lit(HASHED)).cast("int")
    own = docs.sparkSession.createDataFrame([(bytearray(w),) for w in words] or [(bytearray(),)], "word binary")  # VOCABULARY rows
    others = counts.join(F.broadcast(own), "word", "left_anti").select(F.xxhash64("word").alias("rare"), bucket.alias("bucket"), "n")
    of_bucket = others.groupBy("bucket").agg(F.sum("n").alias("total"))
    totals = {r["bucket"]: r["total"] for r in of_bucket.collect()}  # HASHED rows
    often = np.zeros(_SIZE)
    for k, t in totals.items():
        often[bucket_id(k)] = t
    for r in counts.join(F.broadcast(own), "word", "left_semi").collect():
        often[words[bytes(r["word"])]] = r["n"]
    log_total = F.element_at(F.create_map(*(x for k, t in sorted(totals.items()) for x in (F.lit(k), F.lit(math.log(t))))), F.col("bucket")) if totals else F.lit(0.0)
    known, shares = _known(others.groupBy("rare").agg(F.max(F.log("n") - log_total).alias("share"), F.max("n").alias("n")))
    rows = stored(encoded(docs, words, known), "encoded")
    flat = Network(often=often).flat()
    total = docs.agg(F.sum(F.octet_length(docs["text"].cast("string")))).first()[0] or 0
    n_groups = max(1, math.ceil(total / GROUP_BYTES))
    for turn in range(ROUNDS):
        flat = _average(_dealt(rows, n_groups), flat, turn, n_groups)
    return Model(words, flat, known, shares, -math.log(1 + max(totals.values(), default=1))), rows


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood for each row.

    With another corpus' model, words it never met score as if once met."""
    if model is None:
        model, rows = train(docs)
    else:
        rows = stored(encoded(docs, model.words, model.known), "encoded")
    shared = docs.sparkSession.sparkContext.broadcast(model.flat)

    def work(batches):
        one_thread()
        net = Network(shared.value)
        for batch in batches:
            rows, totals, counts = batch.column(1).to_pylist(), [], []
            for a in range(0, len(rows), 256):
                ids, _, sizes = joined(rows[a : a + 256])
                sums = np.concatenate([[0.0], np.cumsum(net.log_probabilities(ids, np.flatnonzero(ids >= 0)).astype(np.float64))])
                ends = np.cumsum(sizes)
                totals += (sums[ends] - sums[ends - sizes]).tolist()
                counts += sizes.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(totals, pa.float64()), *batch.columns[2:]], ["h", "n_tokens", "total", "doc_id", "told", "n_rare"])

    own = rows.select("h", "ids", "doc_id", "told", F.size("rare").alias("n_rare")).mapInArrow(work, "h bigint, n_tokens bigint, total double, doc_id bigint, told double, n_rare int")
    each = rows.select("h", F.explode("rare").alias("rare"))
    # a mean, so that rows with one text do not add up
    told = each.join(model.shares, "rare", "left").groupBy("h").agg(F.avg(F.coalesce("share", F.lit(model.least))).alias("share"))
    whole = F.col("total") + F.col("told") + F.coalesce(F.col("share") * F.col("n_rare"), F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens")).otherwise(F.lit(0.0))
    return own.join(told.withColumnRenamed("h", "of"), F.col("h") == F.col("of"), "left").select("doc_id", "n_tokens", whole.alias("log_likelihood"), mean.alias("mean_log_likelihood"))


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
