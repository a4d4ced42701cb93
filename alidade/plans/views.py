"""The engine's base tables, derived from the driver's tables by rules that SQL
says as well: documents of one source are programmes, the rest jobs; a word of
middling document frequency is a skill."""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import skills as K


def kept(df: DataFrame) -> DataFrame:
    """Tables that many parts of a plan read: in memory, on disk beyond it; a
    lost part is computed again. Spark finds them again by their plan."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


#: Rows of each programme's symbolic ranking that are kept.
MOST_TOP = 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


class Views:
    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at
        self.first: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        kind = F.when(F.col("source") == "src0", "programme").otherwise("job_ad")
        return self.table("documents").select(F.col("doc_id").alias("record_id"), kind.alias("source_type"), "text", "lang", "source")

    @cached_property
    def bodies(self) -> DataFrame:
        """record_id, text, one row an id: texts of a repeated id in one."""
        own = self.records.select("record_id", "text")
        if own.groupBy("record_id").count().where("count > 1").isEmpty():
            return own
        return own.groupBy("record_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))

    @cached_property
    def terms(self) -> DataFrame:
        words = self.records.select("record_id", F.explode(words_of(F.col("text"))).alias("word"))
        return words.groupBy("record_id", "word").agg(F.count("*").alias("tf"))

    @cached_property
    def taxonomy(self) -> DataFrame:
        # a word counts once a text, where the text is read: what is shuffled is the words' counts
        n = F.length("word")
        df = self.bodies.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).where(n >= 6).groupBy("word").agg(F.count("*").alias("df"))
        level = F.when(n % 4 == 0, "transversal").when(n % 4 == 1, "cross-sector").when(n % 4 == 2, "sector-specific").otherwise("occupation-specific")
        return kept(df.where(F.col("df").between(5, 200)).select(F.concat(F.lit("esco:"), "word").alias("uri"), F.col("word").alias("preferred_label"), level.alias("reuse_level")))

    @cached_property
    def skills(self) -> DataFrame:
        explicit = (F.col("tf") >= 2) | ((F.col("record_id") + F.length("word")) % 2 == 0)
        sure = F.when(explicit, 1.0).otherwise((F.length("word") % 5) / 10.0 + 0.5)
        words = self.records.select("record_id", F.explode(words_of(F.col("text"))).alias("word")).where(F.length("word") >= 6)
        rows = words.join(K.small(self.taxonomy.select(F.col("preferred_label").alias("word"))), "word").groupBy("record_id", "word").agg(F.count("*").alias("tf"))
        return kept(rows.select("record_id", F.concat(F.lit("esco:"), "word").alias("uri"), F.col("word").alias("preferred_label"), "tf", explicit.alias("explicit"), sure.alias("confidence")))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("record_id"), "embedding", F.col("label").alias("cluster_label"))

    @cached_property
    def clusters(self) -> DataFrame:
        v = self.vectors.select("record_id", F.col("cluster_label").alias("c"))
        return self.records.join(v, "record_id", "left").select("record_id", "source_type", F.coalesce("c", F.lit(-1)).alias("cluster_label"))

    @cached_property
    def n_programmes(self) -> DataFrame:
        return self.records.agg(F.count_if(F.col("source_type") == "programme").alias("n_programmes"))

    @cached_property
    def idf(self) -> DataFrame:
        return kept(K.corpus_idf(self.skills, self.records))

    @cached_property
    def programme_idf(self) -> DataFrame:
        own = self.records.where("source_type = 'programme'")
        return K.corpus_idf(self.skills.join(own.select("record_id"), "record_id"), own)

    def weights(self, kind: str = "uniform") -> tuple[DataFrame, DataFrame]:
        """(programme, job) weights: uniform, idf, or idf with programme idf."""
        if kind == "uniform":
            return A.split_weights(K.uniform_weights(self.skills), self.records)
        p, j = A.split_weights(K.idf_weights(self.skills, self.idf), self.records)
        if kind == "programme_idf":
            p = A.split_weights(K.idf_weights(self.skills, self.programme_idf), self.records)[0]
        return p, j

    def symbolic(self, kind: str = "uniform") -> DataFrame:
        return A.set_ranking(*self.weights(kind), self.records)

    def symbolic_some(self, kind: str = "uniform") -> DataFrame:
        """The rows of ``symbolic`` that are not zeros."""
        return A.some_set_scores(*self.weights(kind))

    def symbolic_of_vectors(self) -> DataFrame:
        """programme_id, job_id, sa: the rows of ``symbolic_some`` whose records have vectors."""
        own = [w.join(side.select("record_id"), "record_id", "left_semi") for w, side in zip(self.weights(), self.vector_sides())]
        return A.some_set_scores(*own).select(*A.PAIR, F.col("weighted_jaccard").alias("sa"))

    @cached_property
    def sizes(self) -> tuple[int, int]:
        """Programmes and jobs."""
        return tuple(self.records.agg(*(F.count_if(F.col("source_type") == kind) for kind in ("programme", "job_ad"))).first())

    def symbolic_top(self, top: int, kind: str = "uniform") -> DataFrame:
        """The first ``top`` rows of each programme of ``symbolic``. The first
        MOST_TOP are kept: several parts of a plan take more or fewer of them."""
        if kind not in self.first:
            self.first[kind] = kept(A.top_set_scores(*self.weights(kind), self.records, MOST_TOP))
        return self.first[kind].where(F.col("rank") <= top) if top <= MOST_TOP else A.top_set_scores(*self.weights(kind), self.records, top)

    def vector_sides(self) -> list[DataFrame]:
        typed = self.vectors.where("embedding is not null").join(self.records.select("record_id", "source_type"), "record_id")
        return [typed.where(F.col("source_type") == kind) for kind in ("programme", "job_ad")]

    @cached_property
    def semantic(self) -> DataFrame:
        return A.vector_blocks(*self.vector_sides())

    @cached_property
    def nearest(self) -> DataFrame:
        """The 50 first rows of each programme of ``semantic``."""
        return kept(A.vector_blocks(*self.vector_sides(), top=50))

    @cached_property
    def hybrid(self) -> DataFrame:
        p, j = self.weights("programme_idf")
        return kept(A.hybrid(self.nearest, p, j, self.skills, self.idf, self.n_programmes))

    @cached_property
    def candidates(self) -> DataFrame:
        """Hybrid candidates with the uniform weighted Jaccard beside the cosine."""
        scored = A.candidate_scores(*self.weights(), self.nearest.select("programme_id", "job_id", "cosine"))
        return kept(scored.select("programme_id", "job_id", "cosine", F.round("weighted_jaccard", 9).alias("wj")))

    @cached_property
    def gaps(self) -> DataFrame:
        return A.skill_gaps(self.symbolic_top(20), *self.weights())

    @cached_property
    def rankings(self) -> dict[str, tuple[DataFrame, str]]:
        """Each strategy's first rows: enough for the ten that agreement and means take."""
        return {"sym": (self.symbolic_top(10), "weighted_jaccard"), "sem": (self.nearest, "cosine"), "hyb": (self.hybrid, "hybrid_score")}

    def ranked(self, df: DataFrame, score: str, name: str) -> DataFrame:
        w = Window.partitionBy("programme_id").orderBy(F.desc(score), "job_id")
        return df.select("programme_id", "job_id", F.row_number().over(w).alias(name))
