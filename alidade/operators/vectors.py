"""Vectors of texts: encoding, weighted sections, pooled chunks, best labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels compared at a time; a block of vectors is what each task holds.
LABEL_BLOCK = 4096

# How much each section counts.
SECTION_WEIGHTS = {"outcomes": 0.35, "skills": 0.25, "modules": 0.15, "description": 0.20, "other": 0.05}


def keyword_encoder(keywords: list[str]) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder that counts keywords; a stand-in where no model is at hand."""

    def load():
        return lambda texts: np.array([[t.lower().count(k) for k in keywords] for t in texts], np.float64).reshape(len(texts), len(keywords))

    return load


def encode(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]], width: int) -> Column:
    """Unit vectors of texts (Arrow; the model is loaded once in a worker).
    Null and blank text becomes the zero vector."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            out = np.zeros((len(s), width))
            some = np.flatnonzero(s.fillna("").str.strip() != "")
            if len(some):
                out[some] = model([s.iloc[i] for i in some])
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list((out / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return run(text)


def unit(vector: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("double"))


def _mean(df: DataFrame, key: str, vector: str, weight: Column) -> DataFrame:
    """key, embedding: the unit of the weighted sum of each key's vectors."""
    flat = df.select(key, weight.alias("__w"), F.posexplode(vector).alias("__at", "__x"))
    sums = flat.groupBy(key, "__at").agg(F.sum(F.col("__x") * F.col("__w")).alias("__x"))
    rows = sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__x"))), lambda e: e["__x"]).alias("embedding"))
    return rows.select(key, unit(F.col("embedding")).alias("embedding"))


def section_vectors(sections: DataFrame, whole: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """record_id, embedding: sections (record_id, section, embedding) weighted
    and summed; a record without a known section keeps ``whole``'s vector."""
    weights = SECTION_WEIGHTS if weights is None else weights
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    known = sections.where(F.col("section").isin(*weights))
    mixed = _mean(known, "record_id", "embedding", F.element_at(table, F.col("section"))).withColumnRenamed("embedding", "mixed")
    full = F.transform("embedding", lambda x: x.cast("double"))
    return whole.select("record_id", "embedding").join(mixed, "record_id", "left").select("record_id", F.coalesce("mixed", unit(full)).alias("embedding"))


def word_chunks(df: DataFrame, most: int = 256) -> DataFrame:
    """record_id, at, chunk: runs of at most ``most`` words of ``text``."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda x: x != "")
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / most).cast("int")))
    return df.select("record_id", words.alias("w")).select("record_id", "w", F.explode(starts).alias("at")).select("record_id", "at", F.array_join(F.slice("w", F.col("at") * most + 1, F.lit(most)), " ").alias("chunk"))


def pooled(chunks: DataFrame) -> DataFrame:
    """record_id, embedding: the unit of the mean of (record_id, embedding) rows."""
    return _mean(chunks, "record_id", "embedding", F.lit(1.0))


def best_labels(candidates: DataFrame, labels: DataFrame, block: int = LABEL_BLOCK) -> DataFrame:
    """candidate_id, uri, cosine: the label nearest each candidate's vector.

    Labels (uri, embedding) are the query set, gone through in blocks of about
    ``block``; each block is a broadcast of that size, however many labels there
    are. Of equal cosines the least uri stays. Null vectors have no label."""
    have = labels.where("embedding is not null").select("uri", "embedding")
    n_blocks = max(1, -(-have.count() // block))
    spark, out = candidates.sparkSession, None
    for k in range(n_blocks):
        part = sorted(have.where(F.pmod(F.xxhash64("uri"), F.lit(n_blocks)) == k).collect(), key=lambda r: r[0])
        if not part:
            continue
        matrix = np.array([r[1] for r in part], np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast(([r[0] for r in part], matrix))

        def work(frames, shared=shared):
            uris, matrix = shared.value
            for f in frames:
                v = np.array(f["embedding"].tolist(), np.float64).reshape(len(f), matrix.shape[1])
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for a in range(0, max(1, len(f)), 1024):
                    s = np.round(v[a : a + 1024] @ matrix.T, 9)
                    at = s.argmax(1)
                    yield pd.DataFrame({"candidate_id": f["candidate_id"].iloc[a : a + 1024].to_numpy(), "uri": [uris[i] for i in at], "cosine": s[np.arange(len(at)), at]})

        own = candidates.where("embedding is not null").select("candidate_id", "embedding").mapInPandas(work, "candidate_id long, uri string, cosine double")
        out = own if out is None else out.unionAll(own)
    if out is None:
        return spark.createDataFrame([], "candidate_id long, uri string, cosine double")
    w = Window.partitionBy("candidate_id").orderBy(F.desc("cosine"), "uri")
    return out.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
