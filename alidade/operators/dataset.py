"""Assembly of the dataset, its statistics, and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble(programmes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Both collections with ``source_type``."""
    return programmes.withColumn("source_type", F.lit("programme")).unionByName(jobs.withColumn("source_type", F.lit("job_ad")), allowMissingColumns=True)


def join_by_record(skills: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Adds the columns of ``embeddings`` that ``skills`` lacks."""
    return skills.join(embeddings.select("record_id", *(c for c in embeddings.columns if c not in skills.columns)), "record_id", "left")


def text_lengths(records: DataFrame, column: str = "text") -> DataFrame:
    n = F.length(column)
    p = lambda q: F.round(F.percentile(n, F.lit(q)), 1)
    return records.agg(F.round(F.avg(n), 1).alias("mean"), p(0.5).alias("median"), p(0.1).alias("p10"), p(0.9).alias("p90"), F.min(n).alias("min"), F.max(n).alias("max"))


def top_skills(skills: DataFrame, records: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent labels overall and by source type, in one pass."""
    typed = skills.join(records.select("record_id", "source_type"), "record_id")
    counts = typed.groupingSets([("preferred_label",), ("source_type", "preferred_label")], "source_type", "preferred_label").agg(F.count("*").alias("n"), F.grouping("source_type").alias("g"))
    rows = counts.select(F.when(F.col("g") == 1, "all").otherwise(F.col("source_type")).alias("scope"), "preferred_label", "n")
    w = Window.partitionBy("scope").orderBy(F.desc("n"), "preferred_label")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def coverage_rate(records: DataFrame, have: DataFrame) -> DataFrame:
    """Share of records, by source type, that occur in ``have``."""
    hit = have.select("record_id").distinct().withColumn("hit", F.lit(1.0))
    return records.join(hit, "record_id", "left").groupBy("source_type").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias("covered"))


def skills_per_record(skills: DataFrame, records: DataFrame) -> DataFrame:
    by = records.select("record_id").join(skills.groupBy("record_id").agg(F.count("*").alias("n")), "record_id", "left").fillna(0, ["n"])
    return by.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.count_if(F.col("n") == 0).alias("n_empty"), F.max("n").alias("max"))


def kmeans_labels(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """record_id, cluster_label by K-Means on L2-normalised vectors; a zero
    vector becomes uniform; k is at most the number of rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    flat = F.when(norm < 1e-8, F.array_repeat(F.lit(1.0), F.size("embedding"))).otherwise(F.col("embedding").cast("array<double>"))
    rows = Normalizer(inputCol="v", outputCol="features").transform(vectors.select("record_id", array_to_vector(flat).alias("v")))
    n = rows.limit(k).count()
    if n < 2:
        return vectors.select("record_id", F.lit(0).alias("cluster_label"))
    return KMeans(k=min(k, n), seed=seed).fit(rows).transform(rows).select("record_id", F.col("prediction").alias("cluster_label"))


def bisecting_labels(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Hierarchical labels that scale: bisecting K-Means."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("record_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return BisectingKMeans(k=k, seed=seed).fit(rows).transform(rows).select("record_id", F.col("prediction").alias("cluster_label"))


def skill_tfidf(skills: DataFrame, records: DataFrame) -> DataFrame:
    """record_id, uri, w: sublinear tf, smooth idf, L2-normalised by record."""
    n = records.agg(F.count("*").alias("n"))
    tf = skills.groupBy("record_id", "uri").agg((1 + F.log(F.count("*"))).alias("tf"))
    df = tf.groupBy("uri").agg(F.count("*").alias("df"))
    raw = tf.join(df, "uri").join(F.broadcast(n)).withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("record_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "record_id").select("record_id", "uri", (F.col("raw") / F.col("norm")).alias("w"))


def cluster_sizes(clusters: DataFrame, skills: DataFrame, n: int = 5) -> DataFrame:
    """cluster_label, size, top: the most frequent labels of each cluster."""
    size = clusters.groupBy("cluster_label").agg(F.count("*").alias("size"))
    often = clusters.join(skills, "record_id").groupBy("cluster_label", "preferred_label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster_label").orderBy(F.desc("n"), "preferred_label")
    top = often.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("cluster_label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "preferred_label"))), lambda x: x["preferred_label"]), ",").alias("top"))
    return size.join(top, "cluster_label", "left")
