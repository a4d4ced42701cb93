"""Mixing sources to target weights by Pareto order sampling.

Targets: sources weigh by a rule and share all words; a target stops at
MOST_COPIES times its source's words and the excess is shared again by weight
among the others until none is above.

Inclusion: a document of weight w is expected r = min(MOST_COPIES, scale * w)
times, where each source's scale makes the expected words its target. floor(r)
whole copies are certain; the rest, p = r - floor(r), differs from document to
document. Documents are ranked by

    (u / (1 - u)) / (p / (1 - p))

with u a hash of the document, and the lowest ranks are taken, each once, until
the words left to take are reached (the document at the edge is taken if that
comes nearer). By default a document weighs LONGER to the power of its size's
logarithm (see ``length_weight``): of two documents the longer one, which says
more, is likelier to be taken or repeated.

The cut is found by radix: words are summed by source and the next RADIX bits
of the rank's order-preserving 62-bit key, the bin in which the cut falls is
opened again, until bins are small; only the keys of that bin are sorted. No
source ever meets in one task, however many rows it holds. What is decided for
a source is one row (scale, key at the cut), so whole documents are told apart
where they are read and are not shuffled.

Rows: null text has size 0. A null source is a source of its own and comes
last. Repeated rows are ranked alike, and each counts with its own words; if
the cut falls among rows alike in doc_id and text, as many of them are taken as
come nearest. Documents of size 0 take nothing. A null or negative document
weight counts as 0: such a document is taken only if its source's target needs
all others MOST_COPIES times. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import long_id, stored, table

MOST_COPIES = 3
RADIX = 10
SMALL_BIN = 20_000
LONGER = 1.5
LEAST_WEIGHT = 1e-9


def words(text) -> Column:
    """Number of runs of characters other than space and \\t-\\r."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "), " ", -1))) - F.when(
        text.isNull(), F.lit(0)
    ).otherwise(
        # leading and trailing separators leave an empty piece each; a blank text is one of them or both
        F.when(text.rlike("\\A[\\x20\\x09-\\x0D]"), 1).otherwise(0)
        + F.when(text.rlike("[^\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]+\\z") | text.rlike("\\A[\\x20\\x09-\\x0D]+\\z") | (text == ""), 1).otherwise(0)
    )


def source_targets(sizes: DataFrame, weight) -> DataFrame:
    """source, source_size, weight, target from a table (source, size).

    ``weight`` maps the source's rank column (from 0, by code point, null last)
    to its weight. Ranks come from a range sort and each partition's count, so
    no task holds all sources; the shares come from rounds of sums.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = stored(by_source.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in ordered.groupBy(F.shiftright("at", 33)).count().collect()):
        before.append((part, total))
        total += n
    first = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    rank = F.element_at(first, F.shiftright("at", 33)) + F.col("at").bitwiseAND((1 << 33) - 1)
    ranked = stored(ordered.select("source", "source_size", weight(rank).cast("double").alias("weight")), "weights")
    most = F.col("source_size") * F.lit(float(MOST_COPIES))
    share = ranked.agg(F.sum("source_size"), F.sum(F.when(F.col("source_size") > 0, F.col("weight")))).first()
    left, weights = float(share[0] or 0), float(share[1] or 0)
    unit = left / weights if weights else 0.0
    # a unit of weight only grows as sources reach their stop; each round stops all that are above
    while True:
        stopped = most < F.col("weight") * F.lit(unit)
        s = ranked.where("source_size > 0").agg(F.sum(F.when(stopped, most)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not s[1]:
            break
        new = (left - float(s[0] or 0)) / float(s[1])
        if new <= unit * (1 + 1e-12):
            break
        unit = new
    return ranked.select("source", "source_size", "weight", F.least(most, F.col("weight") * F.lit(unit)).alias("target"))


def _order_key(rank: Column) -> Column:
    """A long from 0 up that orders like the rank, which is positive."""
    return F.least(F.lit((1 << 62) - 1).cast("double"), rank / (rank + 1.0) * float(1 << 62)).cast("bigint")


def length_weight(size: Column) -> Column:
    """LONGER for each tenfold of the size."""
    return F.pow(F.lit(LONGER), F.log10(F.greatest(F.lit(1), size)))


def _facts(docs: DataFrame, seed: int, document_weight) -> DataFrame:
    """``docs`` with __source, __size, __h (a hash of id and text), __w."""
    text = docs["text"].cast("string")
    rows = docs.select("*", docs["source"].cast("string").alias("__source"), words(text).cast("bigint").alias("__size"), F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(text, F.lit("")), F.lit(seed)).alias("__h"))
    weight = (length_weight if document_weight is None else document_weight)(F.col("__size"))
    return rows.withColumn("__w", F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(weight.cast("double"), F.lit(0.0))))


def _scales(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """s, source_size, target, scale: what makes each source's expected words
    its target. Scales only grow as documents reach MOST_COPIES; each round
    stops all that are above."""
    sums = stored(rows.where("__size > 0").groupBy("__source", "__w").agg(F.sum("__size").alias("words")), "weights-of-documents")
    state = stored(targets.select(F.col("source").alias("s"), "source_size", "target", F.lit(0.0).alias("scale"), F.lit(True).alias("open")), "scales")
    stop = F.col("scale") * F.col("__w") >= MOST_COPIES
    while not state.where("open").isEmpty():
        own = sums.join(state.where("open").select(F.col("s").alias("of"), "scale"), sums["__source"].eqNullSafe(F.col("of")))
        told = own.groupBy("of").agg(F.sum(F.when(stop, F.col("words") * float(MOST_COPIES)).otherwise(0.0)).alias("fixed"), F.sum(F.when(stop, 0.0).otherwise(F.col("words") * F.col("__w"))).alias("free"))
        new = F.when(F.col("free") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("fixed")) / F.col("free"))
        joined = state.join(told, state["s"].eqNullSafe(told["of"]), "left").withColumn("new", F.when(F.col("open"), new))
        grows = F.coalesce(F.col("new") > F.col("scale") * (1 + 1e-12), F.lit(False))
        state = stored(joined.select("s", "source_size", "target", F.when(grows, F.col("new")).otherwise(F.col("scale")).alias("scale"), grows.alias("open")), "scales")
    return state.select("s", "source_size", "target", "scale")


def _expected(scale: Column, w: Column) -> tuple[Column, Column]:
    """Certain copies, and the chance of one more."""
    r = F.least(F.lit(float(MOST_COPIES)), scale * w)
    whole = F.floor(r + 1e-9)
    return whole.cast("bigint"), F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), r - whole))


def _key(h: Column, p: Column) -> Column:
    u = (F.shiftrightunsigned(h, 11) + 0.5) / float(1 << 53)
    return _order_key((u / (1 - u)) / (p / (1 - p)))


def _cuts(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """s, source_size, target, scale, cut, take, ties: of the rows of a source,
    those with a key below the cut are taken, and ``take`` of the ``ties`` at it."""
    whole, p = _expected(F.col("scale"), F.col("__w"))
    ranked = rows.where("__size > 0").join(scales, rows["__source"].eqNullSafe(scales["s"])).select("s", F.col("__size").alias("size"), whole.alias("whole"), _key(F.col("__h"), p).alias("key"))
    ranked = stored(ranked.where(F.col("whole") < MOST_COPIES).select("s", "size", "key").unionAll(ranked.where("whole > 0").select("s", (-F.col("size") * F.col("whole")).alias("size"), F.lit(-1).cast("bigint"))), "ranked")
    held = ranked.where("key < 0").groupBy("s").agg((-F.sum("size")).alias("held"))
    ranked = ranked.where("key >= 0")
    state = scales.join(held.withColumnRenamed("s", "of"), F.col("s").eqNullSafe(F.col("of")), "left")
    state = state.select("s", F.greatest(F.lit(0.0), F.col("target") - F.coalesce("held", F.lit(0))).alias("left"), F.lit(0).cast("bigint").alias("low"))
    # written, so that it is known to be small: joins with it are broadcast and no source meets in one task
    state, bits = stored(state.where("left > 0"), "cut"), 62
    while bits > 0:
        step = min(RADIX, bits)
        bits -= step
        here = state.withColumnRenamed("s", "of")
        inside = ranked.join(here, ranked["s"].eqNullSafe(F.col("of"))).where(F.shiftright("key", bits + step) == F.shiftright("low", bits + step))
        bins = inside.groupBy("s", "left", F.shiftright("key", bits).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        run = Window.partitionBy("s").orderBy("bin")  # at most 2 ** RADIX rows of a source
        bins = bins.withColumn("upto", F.sum("words").over(run))
        # the last bin stands for sources whose words all together are fewer
        last = F.col("bin") == F.max("bin").over(Window.partitionBy("s"))
        reach = bins.withColumn("ok", (F.col("upto") >= F.col("left")) | last).where("ok")
        cut = reach.groupBy("s").agg(F.min_by(F.struct("bin", (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), "n"), F.col("bin")).alias("c"))
        state = stored(cut.select("s", "c.left", F.shiftleft("c.bin", bits).alias("low"), F.col("c.n").alias("n")), "cut")
        if (state.agg(F.max("n")).first()[0] or 0) <= SMALL_BIN:
            break
    here = state.select(F.col("s").alias("of"), "left", F.shiftright("low", bits).alias("bin"))
    inside = ranked.join(here, ranked["s"].eqNullSafe(F.col("of"))).where(F.shiftright("key", bits) == F.col("bin"))
    keys = inside.groupBy("s", "left", "key").agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
    order = Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    keys = keys.withColumn("before", F.sum("words").over(order) - F.col("words"))
    # of rows alike, as many as come nearest; at the edge the last key that is begun
    take = F.least(F.col("ties"), F.greatest(F.lit(0), F.ceil((F.col("left") - F.col("before")) * F.col("ties") / F.col("words") - 0.5))).cast("bigint")
    begun = keys.where(F.col("before") < F.col("left")).groupBy("s").agg(F.max_by(F.struct("key", take.alias("take"), "ties"), F.col("key")).alias("c"))
    at = begun.select(F.col("s").alias("of"), F.col("c.key").alias("cut"), "c.take", "c.ties")
    out = scales.join(at, F.col("s").eqNullSafe(F.col("of")), "left").drop("of")
    return stored(out.select("s", "source_size", "target", "scale", F.coalesce("cut", F.lit(-1).cast("bigint")).alias("cut"), F.coalesce("take", F.lit(0).cast("bigint")).alias("take"), F.coalesce("ties", F.lit(0).cast("bigint")).alias("ties")), "cuts")


def _decided(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and copies as __source_size and so on."""
    whole, p = _expected(F.col("scale"), F.col("__w"))
    names = rows.columns
    known = rows.join(cuts, rows["__source"].eqNullSafe(cuts["s"])).withColumn("__whole", whole).withColumn("__key", _key(F.col("__h"), p))
    at = F.col("__key") == F.col("cut")

    def with_copies(part: DataFrame, more: Column) -> DataFrame:
        copies = F.when(F.col("__size") > 0, F.least(F.lit(MOST_COPIES).cast("bigint"), F.col("__whole") + more.cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
        return part.select(*names, F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), copies.alias("__copies"))

    some = at & (F.col("take") > 0) & (F.col("take") < F.col("ties")) & (F.col("__size") > 0) & (F.col("__whole") < MOST_COPIES)
    plain = (F.col("__key") < F.col("cut")) | at & (F.col("take") >= F.col("ties"))
    if cuts.where("take > 0 and take < ties").isEmpty():
        return with_copies(known, plain)
    tied = known.where(some).withColumn("__n", F.row_number().over(Window.partitionBy("s").orderBy("__key", "__h")))
    return with_copies(known.where(~some), plain).unionAll(with_copies(tied, F.col("__n") <= F.col("take")))


def pareto_mix(docs: DataFrame, weight, seed: int = 17, document_weight=None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row.

    ``weight`` maps a source's rank to its weight, ``document_weight`` a
    document's size to its own."""
    rows = stored(_facts(docs, seed, document_weight).select(long_id(docs).alias("doc_id"), "__source", "__size", "__h", "__w"), "sizes")
    told = _decided(rows, _cuts(rows, _scales(rows, _targets(rows, weight))))
    return told.select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


def _targets(rows: DataFrame, weight) -> DataFrame:
    return stored(source_targets(rows.select(F.col("__source").alias("source"), F.col("__size").alias("size")), weight).select("source", "source_size", "target"), "targets")


def mixed_documents(docs: DataFrame, weight, seed: int = 17, document_weight=None) -> DataFrame:
    """The mix: the documents taken at least once, with all their columns, and
    copies (how often) and taken (words so often). Columns of these names are
    replaced."""
    rows = stored(_facts(docs, seed, document_weight).select("__source", "__size", "__h", "__w"), "sizes")
    told = _decided(_facts(docs, seed, document_weight), _cuts(rows, _scales(rows, _targets(rows, weight))))
    own = [c for c in docs.columns if c not in ("copies", "taken")]
    return told.where("__copies > 0").select(*own, F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))


def one_two_three(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating."""
    return F.pmod(rank, F.lit(3)) + 1


def op5_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix(table(spark, sf_dir, "documents"), one_two_three)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
