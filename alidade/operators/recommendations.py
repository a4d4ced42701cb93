"""Gaps, trends and recommendation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import top_by


def best_strategy(means: dict[str, float | None]) -> str:
    """The strategy whose mean rho with its peers is highest; ``means`` has
    "symbolic-semantic" and so on. Ties go in order; all undefined: hybrid."""
    names = ("symbolic", "semantic", "hybrid")
    own = {n: [v for k, v in means.items() if n in k.split("-") and v is not None and v == v] for n in names}
    known = {n: sum(v) / len(v) for n, v in own.items() if v}
    return max(known, key=lambda n: (known[n], -names.index(n))) if known else "hybrid"


def top_gap_uris(gaps: DataFrame, n: int = 5) -> DataFrame:
    """programme_id, gaps: the gap skills most frequent over its jobs, in order."""
    often = gaps.groupBy("programme_id", "gap_uri").agg(F.count("*").alias("often"))
    top = top_by(often, n, F.desc("often"), "gap_uri")
    return top.groupBy("programme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gap_uri"))), lambda x: x["gap_uri"]).alias("gaps"))


def pair_gaps(gaps: DataFrame, n: int = 3) -> DataFrame:
    """programme_id, job_id, gaps: the heaviest gaps of each pair, in order."""
    w = Window.partitionBy("programme_id", "job_id").orderBy(F.desc("gap_weight"), "gap_uri")
    top = gaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.groupBy("programme_id", "job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gap_uri"))), lambda x: x["gap_uri"]).alias("gaps"))


def market_trends(skills: DataFrame, records: DataFrame, n: int = 50) -> DataFrame:
    """Skills by how much more often jobs ask for them than programmes have them."""
    typed = skills.select("record_id", "uri").distinct().join(records.select("record_id", "source_type"), "record_id")
    size = records.agg(F.count_if(F.col("source_type") == "job_ad").alias("nj"), F.count_if(F.col("source_type") == "programme").alias("np"))
    by = typed.groupBy("uri").agg(F.count_if(F.col("source_type") == "job_ad").alias("jobs"), F.count_if(F.col("source_type") == "programme").alias("programmes"))
    demand, supply = F.try_divide(F.col("jobs"), F.col("nj")), F.try_divide(F.col("programmes"), F.col("np"))
    rows = by.join(F.broadcast(size)).select("uri", F.round(demand, 9).alias("demand"), F.round(supply, 9).alias("supply"), F.round(demand - supply, 9).alias("trend"))
    return rows.orderBy(F.desc("trend"), "uri").limit(n)


def recommendations(ranking: DataFrame, score: str, strategy: str, gaps: DataFrame, n: int = 10) -> DataFrame:
    """Ranked jobs of each programme with the pair's heaviest gaps."""
    top = top_by(ranking, n, F.desc(score), "job_id").select("programme_id", "job_id", "rank", F.col(score).alias("score"))
    rows = top.join(pair_gaps(gaps), ["programme_id", "job_id"], "left")
    return rows.select("*").withColumn("strategy", F.lit(strategy)).withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>")))


def export_mapping(ranking: DataFrame, score: str, gaps: DataFrame, labels: DataFrame, n: int = 10) -> DataFrame:
    """Top n with the labels of up to three gaps joined by "; "."""
    w = Window.partitionBy("programme_id", "job_id").orderBy(F.desc("gap_weight"), "gap_uri")
    named = gaps.withColumn("r", F.row_number().over(w)).where("r <= 3").join(labels, F.col("gap_uri") == F.col("uri"), "left")
    text = named.groupBy("programme_id", "job_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("preferred_label", "gap_uri").alias("l")))), lambda x: x["l"]), "; ").alias("missing")
    )
    top = top_by(ranking, n, F.desc(score), "job_id").select("programme_id", "job_id", "rank", F.col(score).alias("score"))
    return top.join(text, ["programme_id", "job_id"], "left").withColumn("missing", F.coalesce("missing", F.lit("")))


def safe_mean(value: Column) -> Column:
    """Aggregate: the mean of what is neither null nor NaN."""
    return F.avg(F.when(~F.isnan(value), value))
