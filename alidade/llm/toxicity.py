"""Toxicity by weak supervision.

1. Lexicons: words and word beginnings are counted in toxic and clean labelled
   training rows and those that point to toxicity beyond chance stay, by kind
   and precision; a short fixed lexicon of insults stands beside them.
2. Voters: each lexicon and each pattern (insult near a pronoun, shouting,
   marks) votes toxic, clean or abstains.
3. Label model: on the training rows, expectation-maximisation estimates each voter's accuracy and the correlation of each
   pair given the label; correlated voters share one vote's weight.
4. A linear classifier (logistic regression, numpy) is trained on the posterior
   labels and scores every document.

Only rows whose crc32(doc_id) mod 3 is not 1 are learnt from: of those,
MOST_LABELLED at most, the lowest by a hash. All documents are scored whole.

Rows: null text is empty; empty text gets the score of a text without votes.
Repeated rows are scored alike; null labels are left out; without labels the
lexicons are empty and all scores are low. An empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, stored, table

MOST_LABELLED = 40_000
SHORTEST, LONGEST = 3, 7
PRECISION = 0.97
#: Evidence (log-likelihood ratio against the share of toxic rows) that a term
#: needs; among a million terms one gets there by chance.
EVIDENCE = 13.8
MOST_TERMS = 20_000
THRESHOLD = 0.7
CACHED = 400_000

# Fixed lexicon: insults in the corpus' languages.
INSULTS = frozenset(
    "idiot moron loser scum trash clown pathetic worthless disgusting stupid dumb imbecile "
    "idiotin trottel vollidiot abschaum widerlich dummkopf blödmann arschloch schwachkopf "
    "idiote imbécile crétin connard abruti minable dégoûtant ordure débile "
    "idiota imbécil estúpido estúpida basura asqueroso asquerosa payaso escoria".split()
)

_WORD = re.compile(r"[^\W\d_]+")
_NEAR_PRONOUN = re.compile(r"\b(?:you|your|du|dich|tu|toi|vous|tú|ti|usted)\b[^.!?]{0,40}", re.I)

#: Lexicon voters by kind and precision band.
BANDS = ((0.995, "sure"), (0.0, "likely"))
VOTERS = [f"{k}_{b}" for k in ("word", "start") for _, b in BANDS] + ["fixed", "several", "dense", "near_pronoun", "shouting", "marks", "long_clean"]


def terms_of(text: str) -> set[str]:
    """``=word`` for each word and the beginnings of longer ones."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) <= 40:
            out.add("=" + w)
        out.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the labelled rows learnt from, MOST_LABELLED at most."""
    of = labels.where("toxic is not null").select(long_id(labels).alias("l_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    few = of.where(~_held_out(F.col("l_id"))).orderBy(F.xxhash64("l_id", F.lit(3)), "l_id", "toxic").limit(MOST_LABELLED)
    rows = docs.select(long_id(docs).alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(few), F.col("doc_id") == F.col("l_id")).select("text", "toxic")  # MOST_LABELLED narrow rows


def mine_terms(rows: DataFrame, share: float) -> dict[str, float]:
    """Terms that point to toxicity, with their precision, from (text, toxic)
    of which ``share`` are toxic."""

    def work(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in terms_of(text or ""):
                    seen.setdefault(t, [0, 0])[toxic] += 1
            terms = list(seen)
            for a in range(0, len(terms), 100_000):
                part = terms[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[t][0] for t in part], pa.int64()), pa.array([seen[t][1] for t in part], pa.int64())], ["term", "clean", "toxic"])

    counts = rows.select("text", "toxic").mapInArrow(work, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    precision = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    evidence = F.col("toxic") * F.log(precision / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - precision) / (1 - share))).otherwise(0.0)
    good = counts.where((F.col("toxic") > 0) & (precision >= PRECISION) & (evidence >= EVIDENCE))
    top = good.orderBy(F.desc("toxic"), "term").limit(MOST_TERMS).collect()
    held = {r["term"]: r["toxic"] / (r["toxic"] + r["clean"]) for r in top}
    # a beginning that holds by itself stands for its longer ones
    return {t: p for t, p in held.items() if not any((t[1:] if t[0] == "=" else t)[:n] in held for n in range(SHORTEST, len(t)) if (t[1:] if t[0] == "=" else t)[:n] != t)}


class Voters:
    """Votes and features of one text, given the mined terms."""

    def __init__(self, terms: dict[str, float]):
        self._words = {t[1:]: p for t, p in terms.items() if t[0] == "="}
        self._starts = {t: p for t, p in terms.items() if t[0] != "="}
        self._known: dict[str, tuple[int, int]] = {}

    def _of(self, word: str) -> tuple[int, int]:
        """(kind, band) of the term that the word holds: kind 1 a word, 2 a
        beginning, 3 the fixed lexicon, 0 none; bands count from 1."""
        lower = word.lower()
        for n in range(SHORTEST, min(LONGEST, len(lower)) + 1):
            p = self._starts.get(lower[:n])
            if p is not None:
                return 2, 1 if p >= BANDS[0][0] else 2
        p = self._words.get(lower)
        if p is None:
            return (3, 1) if lower in INSULTS else (0, 0)
        return 1, 1 if p >= BANDS[0][0] else 2

    def votes(self, text: str) -> np.ndarray:
        words = _WORD.findall(text)
        known = self._known
        if len(known) > CACHED:
            known.clear()
        counts, kinds, hits = [0] * 5, set(words), set()
        for w in kinds:
            k = known.get(w)
            if k is None:
                k = known[w] = self._of(w)
            if k[0]:
                hits.add(w)
                counts[2 * (k[0] - 1) + k[1] - 1] += 1
        many = sum(map(hits.__contains__, words)) if hits else 0
        out = np.zeros(len(VOTERS))
        out[:5] = [1 if c else 0 for c in counts]
        out[5] = 1 if many >= 3 else 0
        out[6] = 1 if many * 50 > len(words) else 0
        out[7] = 1 if hits and any(hits & set(_WORD.findall(m)) for m in _NEAR_PRONOUN.findall(text)) else 0
        out[8] = 1 if hits and text.isupper() else 0
        out[9] = 1 if hits and text.count("!") * 10 > len(words) else 0
        out[10] = -1 if not hits else 0
        return out


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior toxicity of each row, each voter's log-odds weight when it
    votes, and the voters' correlations given the label.

    EM starts from the labels. The votes of correlated voters overlap, so each
    weight is divided by one plus the sum of its correlations with others."""
    post = np.where(labels > 0, 0.95, 0.02)
    said = votes != 0
    for _ in range(rounds):
        prior = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
        toxic = ((said * post[:, None]).sum(0) + 0.05) / (post.sum() + 0.1)
        clean = ((said * (1 - post)[:, None]).sum(0) + 0.05) / ((1 - post).sum() + 0.1)
        weight = np.log(toxic / clean)
        spread = said - np.outer(post, toxic) - np.outer(1 - post, clean)
        scale = np.sqrt((spread**2).sum(0) + 1e-9)
        correlation = (spread.T @ spread) / np.outer(scale, scale)
        share = weight / (1 + np.clip(correlation, 0, 1).sum(1) - np.diag(correlation))
        odds = np.log(prior / (1 - prior)) + said @ share + np.where(labels > 0, 2.0, -2.0)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, share, correlation


def fit_linear(x: np.ndarray, target: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; bias last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)), x.T @ (target - p) / len(x) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: dict[str, float], weights: np.ndarray):
        self.terms, self.voters, self.weights = terms, Voters(terms), weights

    def score(self, text: str) -> float:
        z = float(self.voters.votes(text) @ self.weights[:-1] + self.weights[-1])
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = stored(training_rows(docs, labels), "toxic-training")
    n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not 0 < toxic < n:
        return Model({}, np.array([0.0] * len(VOTERS) + [-5.0]))
    terms = mine_terms(rows, toxic / n)
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most MOST_TERMS

    def work(batches):
        voters = Voters(shared.value)
        for batch in batches:
            votes = [voters.votes(t or "").tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.list_(pa.float64())), batch.column(1)], ["votes", "toxic"])

    # vote patterns and labels with their counts: few rows, whatever the sample
    counts = rows.select("text", "toxic").mapInArrow(work, "votes array<double>, toxic int").groupBy("votes", "toxic").count().collect()
    counts.sort(key=lambda r: (r["votes"], r["toxic"]))
    n = [r["count"] for r in counts]
    votes = np.repeat(np.array([r["votes"] for r in counts]), n, axis=0)
    toxic = np.repeat(np.array([r["toxic"] for r in counts]), n)
    post, _, _ = label_model(votes, toxic)
    return Model(terms, fit_linear(votes, post))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights))

    def work(batches):
        model = Model(*shared.value)
        for batch in batches:
            scores = [model.score(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(long_id(docs).alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    model, at = train(docs, labels), docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights))

    def work(batches):
        model = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([model.score(t or "") < THRESHOLD for t in batch.column(at).cast(pa.string()).to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
