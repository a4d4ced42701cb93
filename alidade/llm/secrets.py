"""Secret scans: base patterns plus character Markov models.

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples by counting character pairs; a
candidate run of key characters is a secret if its log-likelihood ratio per
pair reaches MARGIN. All of it is DataFrame functions: spans come from a
regular expression's matches and the pieces between them, whose lengths are
summed up; the ratio comes from an array indexed by character pair.

Rows: null text is empty text, which has no spans. Positions are code points,
ends exclusive. A candidate within a base span is that secret already and is
left out; one that crosses a base span, or holds it, is a span of its own. Repeated rows are answered each; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, prefix_max, prefix_sums, table

# Fixed values of the base patterns.
ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Runs that the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9+/_=-]"
MARGIN = 0.6
SAMPLES = 4000

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."

# Fixed word stock of the ordinary identifiers: code, English, German, French, Spanish.
_STOCK = (
    "page name value count index table column update create delete request response server client handler manager service factory "
    "builder config option default number string object array element session message error status result buffer stream reader "
    "writer parser node tree graph vector matrix filter search query order price product customer account address country region "
    "language version release license copyright permission weather garden kitchen yellow mountain history science "
    "through between together another question children government university development important different "
    "zwischen gegen arbeit sprache freund nachbar kirche fenster wasser strasse geschichte wissenschaft gesellschaft "
    "verantwortung sicherheit freiheit menschen zeitung frage antwort beispiel "
    "maison travail monde histoire voiture fleur jardin semaine lumiere chateau bonheur question reponse exemple "
    "connaissance gouvernement toujours maintenant ensemble plusieurs "
    "trabajo mundo historia ciudad puerta ventana semana pregunta respuesta ejemplo gobierno conocimiento siempre "
    "ahora persona importante diferente mientras libertad seguridad"
).split()


def labelled_samples(n: int = SAMPLES, seed: int = 5) -> list[tuple[str, int]]:
    """The default labelled samples: n random strings (1), n identifiers (0)."""
    rng, out = random.Random(seed), []
    kinds = [_ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:62] + "_-", _ALPHABET[26:62], "0123456789abcdef", _ALPHABET[:26] + _ALPHABET[52:62]]
    for k in range(n):
        out.append(("".join(rng.choices(kinds[k % len(kinds)], k=rng.randint(16, 48))), 1))
        words = rng.choices(_STOCK, k=rng.randint(2, 6))
        if k % 3 == 0:  # abbreviations
            words = [w[: rng.randint(2, 5)] if rng.random() < 0.5 else w for w in words]
        case = rng.choice(["lower", "lower", "upper", "capital", "camel"])
        if case == "upper":
            words = [w.upper() for w in words]
        elif case != "lower":
            words = [w.capitalize() if i or case == "capital" else w for i, w in enumerate(words)]
        name = rng.choice(["", "", "_", "_", "-", "/", "."]).join(words)
        if k % 9 == 0:
            name = rng.choice(["_", "__", "-", "/", "."]) + name
        if k % 11 == 0:
            name += rng.choice(["_", "__", "/", "-"])
        if k % 7 == 0:
            name += str(rng.randint(0, 2100))
        out.append((name, 0))
    return out


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios by character pair (row-major) from (sample, label).

    Counted by one aggregation; at most 2 * 67 * 67 counts reach the driver."""
    n, letters = len(_ALPHABET), F.lit(_ALPHABET)
    pair = samples.select(
        "label", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("sample") - 1)), lambda i: F.substring("sample", i, F.lit(2)))).alias("pair")
    )
    place = lambda c: F.instr(letters, c) - 1
    counts = (
        pair.where(F.length("pair") == 2)
        .groupBy("label", place(F.substring("pair", 1, 1)).alias("a"), place(F.substring("pair", 2, 1)).alias("b"))
        .count()
        .where("a >= 0 and b >= 0")
        .collect()
    )
    table = {0: [[1.0] * n for _ in range(n)], 1: [[0.3] * n for _ in range(n)]}
    for r in counts:
        table[int(r["label"] > 0)][r["a"]][r["b"]] += r["count"]
    return [
        math.log(table[1][a][b] / sum(table[1][a])) - math.log(table[0][a][b] / sum(table[0][a])) for a in range(n) for b in range(n)
    ]


def default_ratios(spark: SparkSession) -> list[float]:
    return train(spark.createDataFrame(labelled_samples(), "sample string, label int"))


def _spans(text: Column, pattern: str, kind: int, passes) -> Column:
    """Spans of a kind: the matches in turn, of which those that pass stay.

    ``passes`` maps (match, group) to a boolean column."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if "(" in pattern.replace("(?:", ""):
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    else:
        groups = found
    gaps = F.transform(F.slice(pieces, F.lit(1), F.size(found)), lambda p: F.length(p).cast("bigint"))
    both = F.zip_with(gaps, F.transform(found, lambda m: F.length(m).cast("bigint")), lambda g, m: g + m)
    starts = F.zip_with(prefix_sums(both), gaps, lambda s, g: s + g)
    span = F.zip_with(
        F.arrays_zip(found.alias("m"), groups.alias("g")),
        starts,
        lambda x, s: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(x["m"])).alias("end"), passes(x["m"], x["g"]).alias("ok")),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,ok:boolean>>")
    return F.when(text.rlike(pattern), F.filter(span, lambda s: s["ok"])).otherwise(none)


def ratio(run: Column, ratios: Column) -> Column:
    """Log-likelihood ratio per character pair of a string column."""
    n, letters = len(_ALPHABET), F.lit(_ALPHABET)
    codes = F.transform(F.split(run, ""), lambda c: F.instr(letters, c) - 1)
    sums = F.aggregate(
        codes,
        F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")),
        lambda acc, c: F.struct(
            (acc["sum"] + F.when((acc["last"] >= 0) & (c >= 0), F.coalesce(F.get(ratios, acc["last"] * n + c), F.lit(0.0))).otherwise(0.0)).alias("sum"), c.alias("last")
        ),
    )
    return sums["sum"] / F.greatest(F.lit(1), F.length(run) - 1)


KINDS = ("assign", "access", "hex", "markov")


def find_secrets(docs: DataFrame, ratios: list[float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, ``__text``, and ``__spans``: an array of
    (start, kind, end) in order of start, then kind as in KINDS."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    long_enough = lambda least: lambda _, g: F.length(g) >= least
    table_ = F.lit(ratios)
    rows = docs.select(*(docs[c] for c in keep), text.alias("__text"))
    t = F.col("__text")
    rows = rows.select(
        "*",
        _spans(t, ASSIGN, 0, long_enough(LEAST["assign"])).alias("__assign"),
        _spans(t, ACCESS, 1, long_enough(LEAST["access"])).alias("__access"),
        _spans(t, HEX.replace("+", "{%d,}" % LEAST["hex"]), 2, lambda m, g: F.lit(True)).alias("__hex"),
        _spans(t, CANDIDATE, 3, lambda m, g: ratio(m, table_) >= MARGIN).alias("__markov"),
    )
    base = F.concat("__assign", "__access", "__hex")
    rows = rows.select(*keep, "__text", "__markov", base.alias("__base"))
    # in order of start, a candidate goes if a base span that began before it, or with it, ends no earlier
    rows = rows.select(*keep, "__text", "__base", F.array_sort(F.concat("__base", "__markov")).alias("__all"))
    reach = prefix_max(F.transform("__all", lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0)).cast("bigint")))
    own = F.filter(F.zip_with("__all", reach, lambda s, r: F.when((s["kind"] < 3) | (s["end"] > r), s)), lambda s: s.isNotNull())
    spans = F.when(F.size("__all") == F.size("__base"), F.col("__all")).otherwise(own)
    return rows.select(*keep, "__text", F.array_sort("__base").alias("__base"), spans.alias("__spans"))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced; ``n_chars``, if a column,
    follows the new text. Text without secrets, null text and other columns
    stay as they are."""
    names = docs.columns
    found = find_secrets(docs, ratios, tuple(names))
    # spans that overlap are one cut: a span begins a new one where all before it have ended
    end = lambda s: s["end"].cast("bigint")
    rows = found.withColumn("__before", prefix_max(F.transform("__spans", end)))
    first = F.filter(F.zip_with("__spans", "__before", lambda s, b: F.when((s["start"] >= b) | (b == 0), F.struct(s["start"].alias("start"), b.alias("before")))), lambda c: c.isNotNull())
    rows = rows.withColumn("__cuts", first)
    last = F.coalesce(F.array_max(F.transform("__spans", end)), F.lit(0).cast("bigint"))
    ends = F.concat(F.transform("__cuts", lambda c: c["before"]), F.array(last))
    starts = F.concat(F.transform("__cuts", lambda c: c["start"]), F.array(F.length("__text").cast("bigint")))
    gaps = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("__text"), (a + 1).cast("int"), (b - a).cast("int")))
    rows = rows.withColumn("__new", F.when(F.size("__cuts") > 0, F.array_join(gaps, mark)).otherwise(F.col("text")))
    new = {"text": F.col("__new")}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.size("__cuts") > 0, F.length("__new").cast(kind)).otherwise(F.col("n_chars"))
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in names))


def op1_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, default_ratios(spark))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        long_id(docs).alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("__base")), 256).alias("base_sha256"),
        joined(F.col("__spans")).alias("spans"),
        (F.size("__spans") - F.size("__base")).cast("bigint").alias("n_markov"),
    )
