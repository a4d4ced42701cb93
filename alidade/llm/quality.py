"""Quality rules by weak supervision.

Each rule votes keep (1), reject (-1) or abstains (0) on a document.
Expectation-maximisation on the counts of vote patterns over all documents (at
most 3 ** rules rows, pre-aggregated) estimates how often each rule votes keep
on good and on bad documents when it votes, and the posterior probability of
quality replaces all-must-pass filtering: a rule that errs is outvoted.
Statistics, votes and posterior are DataFrame functions; only the pattern
counts reach the driver.

No label is used. EM starts from each document's share of keep votes; the
ASSUMED accuracies weigh as much as PRIOR_ROWS documents, so they only name
which of the two classes is the good one.

Rows: null text has no words, fails the base rule and is not kept; its
posterior is still given. Repeated rows are judged each; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, stored, table

ROUNDS = 200
THRESHOLD = 0.5

_SPACE = "[\\x20\\x09-\\x0D]"
#: Bits of a window's place, and so the windows that the quick way can tell apart.
PLACE_BITS = 24


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the text statistics the rules look at, one row per row.

    Repeated windows are found by sorting one long for each window, 40 bits of
    a hash above its place; windows whose hashes meet are compared word by
    word. Texts where a hash meets for different windows, and texts of more
    windows than PLACE_BITS count, sort the windows themselves, so the count is exact for
    all."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(long_id(docs).alias("doc_id"), text.alias("t"))
    rows = rows.select(
        "doc_id",
        F.octet_length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.octet_length(F.regexp_replace("t", "[^A-Z]+", "")).cast("bigint").alias("n_upper"),
        (F.octet_length("t") - F.octet_length(F.replace("t", F.lit("!"), F.lit("")))).cast("bigint").alias("n_marks"),
        (F.octet_length("t") - F.octet_length(F.replace("t", F.lit("."), F.lit("")))).cast("bigint").alias("n_stops"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.array_remove(F.split("t", _SPACE + "+"), "").alias("w"),
    )
    line_columns = [F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines")]
    first = F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - 2))
    packed = F.sort_array(
        F.transform(first, lambda x, i: F.shiftleft(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)), PLACE_BITS).bitwiseOR(i.cast("bigint")))
    )
    kinds = [F.size(F.filter("w", lambda x: x.rlike("\\p{L}"))).cast("bigint").alias("n_alpha"), F.size(F.filter("w", lambda x: x.rlike("\\A\\p{L}{1,3}[.,;:]?\\z"))).cast("bigint").alias("n_short")]
    rows = rows.select("*", *line_columns, *kinds, packed.alias("p")).drop("lines")
    places = (1 << PLACE_BITS) - 1
    meet = F.filter(
        F.zip_with("p", F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.when(F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0, F.struct(a.bitwiseAND(places).cast("int").alias("a"), b.bitwiseAND(places).cast("int").alias("b")))),
        lambda m: m.isNotNull(),
    )
    rows = rows.select("*", F.when(F.size("p") > 1, meet).otherwise(F.array().cast("array<struct<a:int,b:int>>")).alias("m")).drop("p")
    same = lambda m, k: F.get("w", m["a"] + k) == F.get("w", m["b"] + k)
    few = F.size("w") <= 1 << PLACE_BITS
    plain = F.forall("m", lambda m: same(m, 0) & same(m, 1) & same(m, 2))
    covered = lambda found: F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2))))
    quick = covered(F.flatten(F.transform("m", lambda m: F.array(m["a"], m["b"]))))
    ranked = F.sort_array(F.transform(first, lambda x, i: F.struct(x.alias("x"), F.get("w", i + 1).alias("y"), F.get("w", i + 2).alias("z"), i.alias("i"))))
    equal = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"])
    slow = covered(F.flatten(F.zip_with(ranked, F.slice(ranked, F.lit(2), F.size(ranked)), lambda a, b: F.when(equal(a, b), F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))
    return rows.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.when(~few, F.size(slow)).when(F.size("m") == 0, F.lit(0)).when(plain, F.size(quick)).otherwise(F.size(slow)).cast("bigint").alias("n_repeat_words"),
        "n_lines",
        "n_upper",
        "n_marks",
        "n_stops",
        "n_alpha",
        "n_short",
    )


def votes() -> dict[str, Column]:
    """The rules, by name: 1 keep, -1 reject, 0 abstain."""
    words, chars, lines = (F.greatest(F.lit(1), F.col(c)) for c in ("n_words", "word_chars", "n_lines"))
    vote = lambda keep, reject: F.when(reject, -1).when(keep, 1).otherwise(0)
    symbols, marks, repeats, stops = (F.col(c) / words for c in ("n_symbols", "n_marks", "n_repeat_words", "n_stops"))
    doubles, capitals, length, line = F.col("n_dup_lines") / lines, F.col("n_upper") / chars, chars / words, words / lines
    letters, short = F.col("n_alpha") / words, F.col("n_short") / words
    return {
        "symbols": vote(symbols < 0.02, symbols > 0.1),
        "marks": vote(marks < 0.02, marks > 0.2),
        "repeats": vote(repeats < 0.05, repeats > 0.35),
        "lines": vote(doubles < 0.05, doubles > 0.35),
        "capitals": vote(capitals.between(0.005, 0.06), capitals > 0.3),
        "word_length": vote(length.between(4.0, 6.2), (length < 3.0) | (length > 7.0)),
        "stops": vote(stops.between(0.03, 0.2), (stops < 0.01) | (stops > 0.25)),
        "line_length": vote(line.between(12, 150), (line < 5) | (line > 400)),
        "letters": vote(letters > 0.95, letters < 0.8),
        "short_words": vote(short > 0.2, short < 0.08),
    }


#: A rule's chance to vote keep on good and on bad documents, before any data,
#: the share of good ones, and how many documents that is worth.
ASSUMED = (0.8, 0.4)
ASSUMED_GOOD = 0.75
PRIOR_ROWS = 4.0


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """EM on (votes, count) rows: the share of good documents, and by rule the
    chances to vote keep given good and given bad, of the documents it votes on.

    Without rounds, what is assumed of all rules: equal votes."""
    n = len(patterns[0][0]) if patterns else 0
    total, k = sum(c for _, c in patterns), PRIOR_ROWS
    good = [(sum(v > 0 for v in p) + 1) / (sum(v != 0 for v in p) + 2) for p, _ in patterns]
    share, model = ASSUMED_GOOD, [ASSUMED] * n
    for _ in range(rounds):
        share = (sum(g * c for g, (_, c) in zip(good, patterns)) + k * ASSUMED_GOOD) / (total + k)
        model = []
        for r in range(n):
            said = [(p[r] > 0, g * c, (1 - g) * c) for g, (p, c) in zip(good, patterns) if p[r]]
            a, b = sum(x for _, x, _ in said), sum(y for _, _, y in said)
            model.append(((sum(x for v, x, _ in said if v) + k * ASSUMED[0]) / (a + k), (sum(y for v, _, y in said if v) + k * ASSUMED[1]) / (b + k)))
        new = [_posterior(p, share, model) for p, _ in patterns]
        still = max((abs(x - y) for x, y in zip(good, new)), default=0) < 1e-9
        good = new
        if still:
            break
    return share, model


def weights(share: float, model: list[tuple[float, float]]) -> tuple[float, list[dict[int, float]]]:
    """The log-odds of good without votes, and what each rule's vote adds."""
    return math.log(share / (1 - share)), [{1: math.log(a / b), -1: math.log((1 - a) / (1 - b)), 0: 0.0} for a, b in model]


def _posterior(pattern, share, model) -> float:
    start, adds = weights(share, model)
    odds = start + sum(w[v] for v, w in zip(pattern, adds))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def judge(docs: DataFrame) -> DataFrame:
    """The statistics, base_failed, the votes, posterior and kept of each row."""
    rows = stored(statistics(docs), "quality")
    rules = votes()
    voted = rows.select("*", *(v.cast("int").alias(f"vote_{k}") for k, v in rules.items()))
    names = [f"vote_{k}" for k in rules]
    patterns = [(tuple(r[c] for c in names), r["count"]) for r in voted.groupBy(*names).count().collect()]
    start, adds = weights(*fit(sorted(patterns)))
    odds = F.lit(start)
    for name, w in zip(names, adds):
        odds = odds + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return voted.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior")
    )
