"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment as A
from ..operators import clustering as C
from ..operators import dataset as B
from ..operators import dedup as D
from ..operators import evaluation as E
from ..operators import recommendations as R
from ..operators import skills as K
from ..operators import tuning as P
from ..operators import vectors as V
from ..sources import files as S
from .sql import compose
from .views import Views

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYWORDS = ["tion", "ing", "ent", "eau", "ich"]
BLOCKED = ["thtion", "erthing"]
ALPHAS = [k / 10 for k in range(11)]
PHRASES = ["released under", "copyright", "idiot"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as long: engines sum in different orders."""
    kinds = {"double": lambda c: F.round(F.col(c), digits) + F.lit(0.0), "int": lambda c: F.col(c).cast("bigint"), "float": lambda c: F.round(F.col(c).cast("double"), digits)}
    return df.select(*(kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None):
    def register(build):
        QUERIES[name] = lambda spark, at: rounded(build(Views(spark, at)))
        if sql is not None:
            SQL[name] = compose(sql)
        return build

    return register


# --- alignment ---------------------------------------------------------------

for _kind, _view in (("uniform", "sym"), ("idf", "sym_idf"), ("programme_idf", "sym_pidf")):
    _name = {"uniform": "symbolic_uniform_rank", "idf": "symbolic_weighted_rank", "programme_idf": "symbolic_weighted_progidf"}[_kind]
    query(_name, f"SELECT programme_id, job_id, round(weighted_jaccard, 6) AS weighted_jaccard, round(overlap_coeff, 6) AS overlap_coeff, round(programme_recall, 6) AS programme_recall FROM {_view}")(lambda v, k=_kind: v.symbolic(k))


@query("symbolic_top20", "SELECT programme_id, job_id, row_number() OVER (PARTITION BY programme_id ORDER BY weighted_jaccard DESC, job_id) AS rank, round(weighted_jaccard, 6) AS weighted_jaccard FROM sym QUALIFY rank <= 20")
def _(v):
    return v.symbolic_top(20).select("programme_id", "job_id", "rank", "weighted_jaccard")


@query("skill_gaps_uniform", "SELECT * FROM gaps")
def _(v):
    return v.gaps


@query("skill_gaps_weighted", """SELECT programme_id, job_id, j.uri AS gap_uri, round(j.w - coalesce(p.w, 0), 4) AS gap_weight FROM (SELECT * FROM sym_idf QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY weighted_jaccard DESC, job_id) <= 20) t
    JOIN w_idf j ON j.record_id = job_id LEFT JOIN w_idf p ON p.record_id = programme_id AND p.uri = j.uri WHERE j.w > coalesce(p.w, 0)""")
def _(v):
    return A.skill_gaps(v.symbolic_top(20, "idf"), *v.weights("idf"))


@query("uniform_weights", "SELECT record_id, uri, w FROM w_uni")
def _(v):
    return K.uniform_weights(v.skills)


@query("corpus_idf", "SELECT uri, df, round(idf, 6) AS idf FROM idf")
def _(v):
    return v.idf


@query("programme_idf", "SELECT uri, df, round(idf, 6) AS idf FROM pidf")
def _(v):
    return v.programme_idf


@query("median_idf", "SELECT round(coalesce(median(idf), 0), 6) AS median_idf FROM idf")
def _(v):
    return K.median_idf(v.idf)


@query("tier_weights", "SELECT uri, CASE reuse_level WHEN 'transversal' THEN 0.3::DOUBLE WHEN 'cross-sector' THEN 0.5::DOUBLE WHEN 'sector-specific' THEN 0.8::DOUBLE WHEN 'occupation-specific' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS tier FROM tax")
def _(v):
    return v.taxonomy.select("uri", K.tier_weight(F.col("reuse_level")).alias("tier"))


@query("idf_weighted_skills", "SELECT record_id, uri, round(w, 6) AS w FROM w_idf")
def _(v):
    return K.idf_weights(v.skills, v.idf)


@query("tier_weighted_skills", """SELECT record_id, uri, round(max(CASE reuse_level WHEN 'transversal' THEN 0.3::DOUBLE WHEN 'cross-sector' THEN 0.5::DOUBLE WHEN 'sector-specific' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END
    * least(idf, 3.0::DOUBLE) * CASE WHEN explicit THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 6) AS w FROM skills JOIN idf USING (uri) JOIN tax USING (uri) GROUP BY ALL""")
def _(v):
    return K.idf_weights(v.skills, v.idf, levels=v.taxonomy)


@query("semantic_cosine", "SELECT programme_id, job_id, round(cosine, 5) AS cosine, round(dot, 5) AS dot FROM sem")
def _(v):
    return rounded(v.semantic, 5)


@query("semantic_variants_nan", "SELECT p.programme_id, p.job_id, round(s.cosine, 5) AS cosine FROM pairs p LEFT JOIN sem s USING (programme_id, job_id)")
def _(v):
    return rounded(A.vector_ranking(v.records, v.vectors), 5)


@query("normalisation_diag", "SELECT max(abs(cosine - dot)) > 0.0001 AS differs, count(*) AS n FROM sem")
def _(v):
    return A.vector_difference(*v.vector_sides()).select((F.col("most") > 1e-4).alias("differs"), "n")


@query("candidates_top50", "SELECT programme_id, job_id, round(cosine, 5) AS cosine FROM top50")
def _(v):
    return rounded(v.nearest.select("programme_id", "job_id", "cosine"), 5)


@query("match_quality", "SELECT programme_id, job_id, round(quality, 6) AS quality FROM quality")
def _(v):
    top = v.nearest.select("programme_id", "job_id")
    return A.match_quality(top, v.skills, v.idf)


@query("minmax_norm", "SELECT programme_id, job_id, round(c0, 6) AS c FROM normed")
def _(v):
    top = v.nearest.select("programme_id", "job_id", "cosine")
    return top.select("programme_id", "job_id", A.minmax("cosine").alias("c"))


@query("confidence_norm", "SELECT DISTINCT programme_id, round(confidence, 6) AS confidence FROM normed")
def _(v):
    return A.confidence(v.nearest, "cosine").select("programme_id", "confidence").distinct()


@query("ipf_two_tier", "SELECT programme_id, job_id, round(penalty, 6) AS penalty FROM (SELECT *, coalesce(f + (1 - f) * (ipf - min(ipf) OVER ()) / nullif(max(ipf) OVER () - min(ipf) OVER (), 0), 1.0) AS penalty FROM (SELECT t.programme_id, t.job_id, ln(1 + n_programmes::DOUBLE / coalesce(o, 1)) AS ipf, CASE WHEN coalesce(o, 1) >= greatest(2, floor(n_programmes * 0.5)) THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS f FROM top50 t LEFT JOIN (SELECT job_id, count(DISTINCT programme_id) AS o FROM (SELECT * FROM top50 QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY cosine DESC, job_id) <= 30) GROUP BY ALL) USING (job_id), np))")
def _(v):
    top = v.nearest.select("programme_id", "job_id", "cosine")
    return A.frequency_penalty(top, "cosine", v.n_programmes).select("programme_id", "job_id", "penalty")


@query("hybrid_rank", "SELECT programme_id, job_id, round(cosine_score, 5) AS cosine_score, round(recall_score, 5) AS recall_score, round(hybrid_score, 5) AS hybrid_score FROM hyb")
def _(v):
    return rounded(v.hybrid, 5)


@query("bm25_rank", """SELECT programme_id, job_id, round(sum(qtf * part), 6) AS bm25_score FROM (SELECT record_id AS programme_id, word, tf AS qtf FROM terms JOIN rec USING (record_id) WHERE source_type = 'programme') q JOIN
    (SELECT t.record_id AS job_id, t.word, i.idf * t.tf * 2.5::DOUBLE / (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part FROM terms t JOIN (SELECT record_id, sum(tf)::DOUBLE AS dl FROM terms JOIN rec USING (record_id) WHERE source_type = 'job_ad' GROUP BY ALL) USING (record_id),
      (SELECT sum(tf)::DOUBLE / (SELECT count(*) FROM rec WHERE source_type = 'job_ad') AS avgdl FROM terms JOIN rec USING (record_id) WHERE source_type = 'job_ad'),
      (SELECT word, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER () ELSE raw END AS idf FROM (SELECT word, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT word, count(*) AS df FROM terms JOIN rec USING (record_id) WHERE source_type = 'job_ad' GROUP BY ALL), (SELECT count(*) AS n FROM rec WHERE source_type = 'job_ad'))) i WHERE i.word = t.word) d USING (word) GROUP BY ALL""")
def _(v):
    return A.bm25(v.terms, v.records)


@query("strategy_summary", "SELECT strategy, n_pairs, round(mean, 6) AS mean, round(median, 6) AS median, round(max, 6) AS max FROM (SELECT 'sym' AS strategy, count(*) AS n_pairs, avg(weighted_jaccard) AS mean, median(weighted_jaccard) AS median, max(weighted_jaccard) AS max FROM sym UNION ALL SELECT 'sem', count(*), avg(cosine), median(cosine), max(cosine) FROM sem)")
def _(v):
    p, j = v.sizes
    return A.set_summary(v.symbolic_some(), "weighted_jaccard", p * j).withColumn("strategy", F.lit("sym")).unionByName(A.vector_summary(*v.vector_sides()).withColumn("strategy", F.lit("sem")))


# --- skills ------------------------------------------------------------------

@query("explicit_dict", "SELECT record_id, uri, tf AS hits FROM skills")
def _(v):
    labels = v.taxonomy.select(F.col("preferred_label").alias("label_lc"), "uri")
    return K.dictionary_matches(v.records, labels, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), longest=1)


@query("relevance_score", "SELECT record_id, uri, round((1.0 + 20.0 * CASE WHEN explicit THEN 1 ELSE 0 END + 2.0 * confidence)::DOUBLE / 24, 6) AS relevance FROM skills WHERE (1.0 + 20.0 * CASE WHEN explicit THEN 1 ELSE 0 END + 2.0 * confidence) / 24 >= 0.35")
def _(v):
    score = K.relevance(F.lit(1.0), F.lit(0.0), F.col("explicit").cast("double"), F.col("confidence"))
    return v.skills.select("record_id", "uri", score.alias("relevance")).where(F.col("relevance") >= K.RELEVANT)


@query("freq_stopwords", "SELECT preferred_label, count(DISTINCT record_id) AS df FROM skills GROUP BY ALL HAVING count(DISTINCT record_id) > 0.1 * (SELECT count(*) FROM rec)")
def _(v):
    return K.frequent_labels(v.skills, v.records, 0.1)


_KEPT = "(NOT preferred_label IN ('thtion', 'erthing') AND (reuse_level IN ('cross-sector', 'transversal') OR " + " OR ".join(f"contains(preferred_label, '{k}')" for k in KEYWORDS) + "))"


@query("skill_filter", f"""WITH d AS (SELECT s.*, reuse_level FROM skills s JOIN tax t USING (uri, preferred_label) WHERE {_KEPT}), st AS (SELECT preferred_label FROM d GROUP BY ALL HAVING count(DISTINCT record_id) > 0.1 * (SELECT count(*) FROM rec))
    SELECT record_id, uri, explicit, confidence FROM d WHERE explicit OR (confidence >= 0.7 AND preferred_label NOT IN (SELECT preferred_label FROM st))""")
def _(v):
    kept = K.filter_skills(v.skills, v.records, v.taxonomy.select("uri", "reuse_level"), KEYWORDS, BLOCKED, share=0.1)
    return kept.select("record_id", "uri", "explicit", "confidence")


@query("skill_columns", "SELECT record_id, array_to_string(list(preferred_label ORDER BY uri) FILTER (explicit), ',') AS explicit_skills, array_to_string(list(preferred_label ORDER BY uri) FILTER (NOT explicit), ',') AS implicit_skills, count(*) AS n FROM skills GROUP BY ALL")
def _(v):
    rows = K.skill_columns(v.skills)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return rows.select("record_id", text("explicit_skills").alias("explicit_skills"), text("implicit_skills").alias("implicit_skills"), F.size("skill_uris").alias("n"))


# --- evaluation --------------------------------------------------------------

_RHO = """SELECT programme_id, CASE WHEN count(*) >= 3 AND count(*) * sum(ra * ra) - sum(ra) ** 2 > 1e-9 AND count(*) * sum(rb * rb) - sum(rb) ** 2 > 1e-9 THEN round((count(*) * sum(ra * rb) - sum(ra) * sum(rb)) / sqrt((count(*) * sum(ra * ra) - sum(ra) ** 2) * (count(*) * sum(rb * rb) - sum(rb) ** 2)), 6) END AS rho, count(*) AS shared
    FROM (SELECT programme_id, rank() OVER (PARTITION BY programme_id ORDER BY sa DESC) + (count(*) OVER (PARTITION BY programme_id, sa) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY programme_id ORDER BY sb DESC) + (count(*) OVER (PARTITION BY programme_id, sb) - 1) / 2.0::DOUBLE AS rb
    FROM (SELECT programme_id, job_id, weighted_jaccard AS sa, cosine AS sb FROM sym JOIN sem USING (programme_id, job_id))) GROUP BY programme_id"""


def _rho(v):
    return E.spearman_of_vectors(v.symbolic_of_vectors(), *v.vector_sides())


query("spearman_pairs", _RHO)(_rho)
query("cross_summary", f"SELECT round(avg(rho), 6) AS mean, round(median(rho), 6) AS median, round(stddev_samp(rho), 6) AS std, round(min(rho), 6) AS min, round(max(rho), 6) AS max FROM ({_RHO})")(lambda v: E.describe(rounded(_rho(v)), "rho"))


@query("topk_jaccard", """SELECT programme_id, round(len(list_intersect(a, b))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS jaccard FROM (SELECT programme_id, coalesce(x.l, []) AS a, coalesce(y.l, []) AS b FROM
    (SELECT programme_id, list(job_id) AS l FROM (SELECT * FROM sym QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY weighted_jaccard DESC, job_id) <= 10) GROUP BY ALL) x FULL JOIN
    (SELECT programme_id, list(job_id) AS l FROM (SELECT * FROM sem QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY cosine DESC, job_id) <= 10) GROUP BY ALL) y USING (programme_id))""")
def _(v):
    return E.top_k_jaccard(v.symbolic_top(10).select("programme_id", "job_id", F.col("weighted_jaccard").alias("sa")), v.nearest.select("programme_id", "job_id", F.col("cosine").alias("sb")))


_TOP1 = "(SELECT programme_id, job_id AS {n} FROM {t} QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY {s} DESC, job_id) = 1)"
_TSYM, _TSEM, _THYB = (_TOP1.format(n=n, t=t, s=s) for n, t, s in (("sym_job", "sym", "weighted_jaccard"), ("sem_job", "sem", "cosine"), ("hyb_job", "hyb", "hybrid_score")))


@query("top1_agreement", f"SELECT programme_id, sym_job, sem_job, hyb_job, (sym_job = sem_job AND sem_job = hyb_job) AS all_agree FROM {_TSYM} JOIN {_TSEM} USING (programme_id) JOIN {_THYB} USING (programme_id)")
def _(v):
    out = None
    for name, (df, score) in v.rankings.items():
        own = E.top1(df, score).withColumnRenamed("top1", f"{name}_job")
        out = own if out is None else out.join(own, "programme_id")
    return out.withColumn("all_agree", (F.col("sym_job") == F.col("sem_job")) & (F.col("sem_job") == F.col("hyb_job")))


_TOPS = " UNION ALL ".join(f"(SELECT programme_id, job_id FROM {t} QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY {s} DESC, job_id) <= 10)" for t, s in (("sym", "weighted_jaccard"), ("sem", "cosine"), ("hyb", "hybrid_score")))
_CONS = f"SELECT programme_id, job_id FROM ({_TOPS}) GROUP BY ALL HAVING count(*) >= 2"
query("consensus", _CONS)(lambda v: E.consensus(list(v.rankings.values())))


@query("precision_ndcg_mrr", f"""WITH rel AS ({_CONS}), t AS (SELECT s.programme_id, s.rank, CASE WHEN rel.job_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS r FROM (SELECT *, row_number() OVER (PARTITION BY programme_id ORDER BY cosine DESC, job_id) AS rank FROM sem QUALIFY rank <= 10) s LEFT JOIN rel USING (programme_id, job_id))
    SELECT programme_id, round(avg(r), 6) AS precision, round(CASE WHEN any_value(n) > 0 THEN sum(r / log2(rank + 1)) / any_value(list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1)))) ELSE 0 END, 6) AS ndcg, round(coalesce(1.0::DOUBLE / min(CASE WHEN r > 0 THEN rank END), 0), 6) AS rr
    FROM t LEFT JOIN (SELECT programme_id, count(*) AS n FROM rel GROUP BY ALL) USING (programme_id) GROUP BY programme_id""")
def _(v):
    return E.retrieval_measures(v.nearest, "cosine", E.consensus(list(v.rankings.values())))


_COV = """SELECT record_id AS programme_id, coalesce(m, 0) AS n_matches, coalesce(m / n::DOUBLE, 0) AS match_share, coalesce(t, 0.0::DOUBLE) AS top_score, coalesce(a, 0.0::DOUBLE) AS mean_match, coalesce(m, 0) < 5 AS low_coverage FROM rec LEFT JOIN
    (SELECT programme_id AS record_id, count(*) FILTER (weighted_jaccard >= 0.05) AS m, count(*) AS n, max(weighted_jaccard) AS t, avg(weighted_jaccard) FILTER (weighted_jaccard >= 0.05) AS a FROM sym GROUP BY ALL) USING (record_id) WHERE source_type = 'programme'"""


def _covered(v):
    return E.coverage_of_some(v.records, v.symbolic_some(), "weighted_jaccard", 0.05)


@query("programme_coverage", f"SELECT programme_id, n_matches, round(match_share, 6) AS match_share, round(top_score, 6) AS top_score, round(mean_match, 6) AS mean_match, low_coverage FROM ({_COV})")
def _(v):
    return _covered(v)


@query("niche_clusters", f"SELECT cluster_label::BIGINT AS cluster_label, count(*) AS n_programmes, count(*) FILTER (low_coverage) AS n_low, round(avg(CASE WHEN low_coverage THEN 1.0 ELSE 0.0 END), 6) AS low_share, round(avg(match_share), 6) AS mean_share FROM ({_COV}) JOIN clu ON record_id = programme_id GROUP BY ALL")
def _(v):
    return E.niche_clusters(_covered(v), v.clusters.select(F.col("record_id").alias("programme_id"), "cluster_label"))


@query("expansion_recs", f"SELECT programme_id, n_matches, 'Programme ' || programme_id || ' matches ' || n_matches || ' jobs; skills: ' || coalesce(l, '') AS message FROM ({_COV}) LEFT JOIN (SELECT record_id AS programme_id, array_to_string(list(preferred_label ORDER BY preferred_label)[1:10], ', ') AS l FROM skills WHERE explicit GROUP BY ALL) USING (programme_id) WHERE low_coverage")
def _(v):
    low = _covered(v).where("low_coverage").select("programme_id", "n_matches")
    labels = v.skills.where("explicit").groupBy(F.col("record_id").alias("programme_id")).agg(F.array_join(F.slice(F.array_sort(F.collect_list("preferred_label")), 1, 10), ", ").alias("l"))
    message = F.concat(F.lit("Programme "), F.col("programme_id").cast("string"), F.lit(" matches "), F.col("n_matches").cast("string"), F.lit(" jobs; skills: "), F.coalesce("l", F.lit("")))
    return low.join(labels, "programme_id", "left").select("programme_id", "n_matches", message.alias("message"))


_CELLS = f"SELECT p.cluster_label::BIGINT AS programme_cluster, j.cluster_label::BIGINT AS job_cluster, count(*) AS n FROM {_TSYM} t JOIN clu p ON p.record_id = programme_id JOIN clu j ON j.record_id = sym_job GROUP BY ALL"


def _cells(v):
    return E.contingency(E.top1(v.symbolic_top(1), "weighted_jaccard"), v.clusters)


query("contingency", _CELLS)(_cells)
query("cramers_v", f"""WITH c AS ({_CELLS}), m AS (SELECT (SELECT sum(n) FROM c)::DOUBLE AS total, (SELECT count(DISTINCT programme_cluster) FROM c) AS nr, (SELECT count(DISTINCT job_cluster) FROM c) AS nc,
    (SELECT sum(n * n / (r * k)::DOUBLE) FROM (SELECT n, sum(n) OVER (PARTITION BY programme_cluster)::BIGINT AS r, sum(n) OVER (PARTITION BY job_cluster)::BIGINT AS k FROM c)) AS s)
    SELECT round(total * (s - 1), 6) AS chi2, (nr - 1) * (nc - 1) AS dof, round(CASE WHEN least(nr, nc) > 1 THEN sqrt(total * (s - 1) / (total * (least(nr, nc) - 1))) ELSE 0 END, 6) AS cramers_v FROM m""")(lambda v: E.cramers_v(_cells(v)))


@query("cluster_scores", "SELECT cluster_label::BIGINT AS cluster_label, round(avg(m), 6) AS mean_top, count(*) AS n FROM (SELECT programme_id, avg(weighted_jaccard) AS m FROM (SELECT * FROM sym QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY weighted_jaccard DESC, job_id) <= 10) GROUP BY ALL) JOIN clu ON record_id = programme_id GROUP BY ALL")
def _(v):
    rows = E.mean_top_scores(v.symbolic_top(10), "weighted_jaccard").join(v.clusters, F.col("record_id") == F.col("programme_id"))
    return rows.groupBy("cluster_label").agg(F.avg("mean_top").alias("mean_top"), F.count("*").alias("n"))


@query("cluster_gaps", "SELECT cluster_label::BIGINT AS cluster_label, gap_uri, count(*) AS n, row_number() OVER (PARTITION BY cluster_label ORDER BY count(*) DESC, gap_uri) AS rank FROM gaps JOIN clu ON record_id = programme_id GROUP BY cluster_label, gap_uri QUALIFY rank <= 10")
def _(v):
    often = v.gaps.join(v.clusters, F.col("record_id") == F.col("programme_id")).groupBy("cluster_label", "gap_uri").agg(F.count("*").alias("n"))
    return A.top_by(often, 10, F.desc("n"), "gap_uri", by="cluster_label")


_MEANS = {t: f"(SELECT programme_id, avg({s}) AS m FROM (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY {s} DESC, job_id) <= 10) GROUP BY ALL)" for t, s in (("sym", "weighted_jaccard"), ("sem", "cosine"), ("hyb", "hybrid_score"))}


@query("best_strategy_cluster", "WITH m AS (" + " UNION ALL ".join(f"SELECT cluster_label, '{t}' AS strategy, {k} AS place, round(avg(m), 6) AS mean FROM {q} JOIN clu ON record_id = programme_id GROUP BY cluster_label" for k, (t, q) in enumerate(_MEANS.items())) + ") SELECT cluster_label::BIGINT AS cluster_label, strategy, mean FROM m QUALIFY row_number() OVER (PARTITION BY cluster_label ORDER BY mean DESC, place) = 1")
def _(v):
    out = None
    for k, (name, (df, score)) in enumerate(v.rankings.items()):
        own = E.mean_top_scores(df, score).join(v.clusters, F.col("record_id") == F.col("programme_id")).groupBy("cluster_label").agg(F.round(F.avg("mean_top"), 6).alias("mean"))
        own = own.select("cluster_label", F.lit(name).alias("strategy"), F.lit(k).alias("place"), "mean")
        out = own if out is None else out.unionAll(own)
    return A.top_by(out, 1, F.desc("mean"), "place", by="cluster_label").select("cluster_label", "strategy", "mean")


@query("kendall_stability", """WITH full_r AS (SELECT programme_id, job_id, row_number() OVER (PARTITION BY programme_id ORDER BY cosine DESC, job_id) AS ra, cosine FROM sem),
    samp AS (SELECT replicate, job_id FROM (SELECT range AS replicate, job_id, count(*) OVER (PARTITION BY range) AS n, row_number() OVER (PARTITION BY range ORDER BY md5(range::VARCHAR || ':' || job_id::VARCHAR), job_id) AS r FROM (SELECT DISTINCT job_id FROM sem), range(3)) WHERE r <= floor(0.8 * n)),
    x AS (SELECT replicate, programme_id, job_id, ra, row_number() OVER (PARTITION BY replicate, programme_id ORDER BY cosine DESC, job_id) AS rb FROM full_r JOIN samp USING (job_id))
    SELECT a.replicate, a.programme_id, round(sum(sign((a.ra - b.ra) * (a.rb - b.rb))) / (any_value(n) * (any_value(n) - 1) / 2), 6) AS tau FROM x a JOIN x b USING (replicate, programme_id) JOIN (SELECT replicate, programme_id, count(*)::DOUBLE AS n FROM x GROUP BY ALL) USING (replicate, programme_id) WHERE a.job_id < b.job_id AND n >= 3 GROUP BY ALL""")
def _(v):
    programmes, jobs = v.vector_sides()
    sample = E.resampled(jobs.select(F.col("record_id").alias("job_id")).distinct(), 3)
    return E.stability(programmes, jobs, sample, 3)


@query("wilcoxon_stat", f"""WITH a AS (SELECT programme_id, m AS x FROM {_MEANS['sym']}), b AS (SELECT programme_id, m AS y FROM {_MEANS['sem']}), d AS (SELECT round(x - y, 9) AS d FROM a JOIN b USING (programme_id)), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0)
    SELECT count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS statistic, round(1 - 2 * least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) / (count(*) * (count(*) + 1) / 2.0::DOUBLE), 6) AS effect FROM r""")
def _(v):
    a, b = E.mean_top_scores(v.symbolic_top(10), "weighted_jaccard"), E.mean_top_scores(v.nearest, "cosine")
    both = a.join(b.withColumnRenamed("mean_top", "other"), "programme_id").select(F.round(F.col("mean_top") - F.col("other"), 9).alias("d"), F.lit(0.0).alias("z"))
    return E.signed_rank(both, "d", "z")


# --- sweeps ------------------------------------------------------------------

def _grid(alphas):
    return "(SELECT unnest([" + ", ".join(f"{a}::DOUBLE" for a in alphas) + "]) AS alpha)"


@query("alpha_sweep", f"SELECT alpha, programme_id, job_id, round(alpha * cosine + (1 - alpha) * wj, 5) AS score FROM cand, {_grid(ALPHAS)}")
def _(v):
    rows = P.with_grid(v.candidates, "alpha", ALPHAS)
    return rounded(rows.select("alpha", "programme_id", "job_id", P.mixed("alpha", "cosine", "wj").alias("score")), 5)


_MET = """WITH s AS (SELECT *, round({score}, 9) AS score FROM cand{grid}), b AS (SELECT {key}job_id, count(*) AS often FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY {key}programme_id ORDER BY score DESC, job_id) = 1) GROUP BY ALL)
    SELECT {key}round(d, 6) AS diversity, g AS n_generalists, most, round(cov, 6) AS cov FROM (SELECT {key}count(*) / sum(often)::DOUBLE AS d, count(*) FILTER (often > 5) AS g, max(often) AS most FROM b{group}) {join} (SELECT {key}stddev_samp(score) / avg(score) AS cov FROM s{group}){using}"""


@query("alpha_metrics", _MET.format(score="alpha * cosine + (1 - alpha) * wj", grid=", " + _grid(ALPHAS), key="alpha, ", group=" GROUP BY alpha", join="JOIN", using=" USING (alpha)"))
def _(v):
    rows = P.with_grid(v.candidates, "alpha", ALPHAS).withColumn("score", F.round(P.mixed("alpha", "cosine", "wj"), 9))
    return P.diversity(rows, "score", ("alpha",))


@query("diversity_metrics", _MET.format(score="cosine", grid="", key="", group="", join=",", using=""))
def _(v):
    return P.diversity(v.candidates, "cosine")


@query("rank_norm", "SELECT programme_id, job_id, round(coalesce((rank() OVER (PARTITION BY programme_id ORDER BY cosine) + (count(*) OVER (PARTITION BY programme_id, cosine) - 1) / 2.0::DOUBLE - 1) / nullif(count(*) OVER (PARTITION BY programme_id) - 1, 0), 0), 6) AS r FROM cand")
def _(v):
    return v.candidates.select("programme_id", "job_id", P.rank_norm("cosine", "programme_id").alias("r"))


for _kind, _expr in (
    ("linear", "0.55::DOUBLE * cosine + 0.45::DOUBLE * wj"),
    ("geometric", "pow(greatest(cosine, 1e-6), 0.55::DOUBLE) * pow(greatest(wj, 1e-6), 0.45::DOUBLE)"),
    ("harmonic", "1 / (0.55::DOUBLE / greatest(cosine, 1e-6) + 0.45::DOUBLE / greatest(wj, 1e-6))"),
):
    query(f"variant_{_kind}", f"SELECT programme_id, job_id, round({_expr}, 5) AS score FROM cand")(lambda v, k=_kind: rounded(v.candidates.select("programme_id", "job_id", P.variant(k, 0.55, "cosine", "wj").alias("score")), 5))


@query("agreement_boost", "SELECT programme_id, job_id, round((0.55::DOUBLE * cosine + 0.45::DOUBLE * wj) * (1 + 0.2::DOUBLE * (1 - abs(cosine - wj))), 5) AS score FROM cand")
def _(v):
    return rounded(v.candidates.select("programme_id", "job_id", P.variant("linear", 0.55, "cosine", "wj", 0.2).alias("score")), 5)


@query("ipf_single", "SELECT programme_id, job_id, round(coalesce(0.3 + 0.7 * (ipf - min(ipf) OVER ()) / nullif(max(ipf) OVER () - min(ipf) OVER (), 0), 1.0), 6)::DOUBLE AS penalty FROM (SELECT t.programme_id, t.job_id, ln(1 + n_programmes::DOUBLE / coalesce(o, 1)) AS ipf FROM top50 t LEFT JOIN (SELECT job_id, count(DISTINCT programme_id) AS o FROM (SELECT * FROM top50 QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY cosine DESC, job_id) <= 20) GROUP BY ALL) USING (job_id), np)")
def _(v):
    return P.single_tier_penalty(v.candidates, "cosine", v.n_programmes).select("programme_id", "job_id", "penalty")


@query("top1_changes", f"SELECT programme_id, sym_job AS base_job, sem_job AS other_job, sym_job <> sem_job AS changed FROM {_TSYM} JOIN {_TSEM} USING (programme_id)")
def _(v):
    return P.changes(E.top1(v.symbolic_top(1), "weighted_jaccard"), E.top1(v.nearest, "cosine"))


_ABL = "SELECT config, count(*) AS n_skills, count(DISTINCT record_id) AS n_records, count(DISTINCT uri) AS n_uris FROM skills, (VALUES " + ", ".join(f"('{k}', {a}, {b}, {c}, {d})" for k, (a, b, c, d) in P.ABLATIONS.items()) + ") g(config, a, b, c, d) WHERE (a * 0.5::DOUBLE + b * (tf >= 3)::INT + c * explicit::INT + d * confidence) / (a + b + c + d) >= 0.35 GROUP BY config"


def _ablation(v):
    rows = v.skills.select("record_id", "uri", F.lit(0.5).alias("ner"), (F.col("tf") >= 3).cast("double").alias("pos"), F.col("explicit").cast("double").alias("dictionary"), F.col("confidence").alias("embedding"))
    return P.ablated(rows).groupBy("config").agg(F.count("*").alias("n_skills"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("uri").alias("n_uris"))


query("ablation_metrics", _ABL)(_ablation)


@query("ablation_deltas", f"WITH m AS ({_ABL}) SELECT m.config, m.n_skills - b.n_skills AS delta, round(100 * (m.n_skills - b.n_skills) / b.n_skills::DOUBLE, 6) AS percent FROM m, m b WHERE b.config = 'baseline'")
def _(v):
    m = _ablation(v)
    b = m.where("config = 'baseline'").select(F.col("n_skills").alias("b"))
    return m.join(F.broadcast(b)).select("config", (F.col("n_skills") - F.col("b")).alias("delta"), (100 * (F.col("n_skills") - F.col("b")) / F.col("b")).alias("percent"))


# --- de-duplication and text ---------------------------------------------------

_FP = "md5(regexp_replace(trim(lower(text)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("fingerprint_dedup", f"SELECT record_id, {_FP} AS fp FROM rec QUALIFY row_number() OVER (PARTITION BY {_FP} ORDER BY record_id) = 1")
def _(v):
    return D.first_of(v.records, D.fingerprint(F.col("text")), ["record_id"]).select("record_id", D.fingerprint(F.col("text")).alias("fp"))


@query("identity_dedup", "SELECT page_id, lower(regexp_extract(url, '^[^?#]*')) AS k FROM pages QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) = 1")
def _(v):
    key = D.identity_key(F.regexp_extract("url", "^[^?#]*", 0), F.col("page_id").cast("string"))
    return D.first_of(v.table("pages"), key, ["page_id"]).select("page_id", key.alias("k"))


@query("title_block_filter", "SELECT p_partkey, p_name FROM part WHERE NOT (contains(lower(trim(p_name)), 'red') OR contains(lower(trim(p_name)), 'steel'))")
def _(v):
    return v.table("part").where(~D.blocked_title(F.col("p_name"), ["red", "steel"])).select("p_partkey", "p_name")


@query("incremental_merge", "SELECT c_custkey, c_acctbal, src FROM (SELECT c_custkey, c_acctbal, 'new' AS src FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, c_acctbal, 'old' FROM customer) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY src) = 1")
def _(v):
    c = v.table("customer").select("c_custkey", "c_acctbal")
    return D.merge_incremental(c.where("c_acctbal > 0").withColumn("src", F.lit("new")), c.withColumn("src", F.lit("old")), "c_custkey")


@query("near_dups", None)
def _(v):
    return D.near_pairs(D.signatures(v.records.select("record_id", "text"), D.normalised(F.col("text"))))


@query("clean_lines", "SELECT record_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (contains(lower(x), 'released under') OR contains(lower(x), 'copyright') OR contains(lower(x), 'idiot'))), chr(10))) AS h FROM rec")
def _(v):
    return v.records.select("record_id", F.md5(T.drop_lines(F.col("text"), PHRASES)).alias("h"))


@query("ws_normalise", "SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[ \\t]+', ' ', 'g'), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\A[ \\n\\t\\r]+|[ \\n\\t\\r]+\\z', '', 'g')) AS h FROM pages")
def _(v):
    return v.table("pages").select("page_id", F.md5(T.collapse_space(F.col("html"))).alias("h"))


@query("url_strip", "SELECT page_id, regexp_replace('see ' || url || ' now', 'https?://[^ \\t\\n\\r]+', '', 'g') AS t FROM pages")
def _(v):
    return v.table("pages").select("page_id", T.drop_urls(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("t"))


@query("cutoff_truncate", "SELECT record_id, md5(CASE WHEN k > 0 THEN array_to_string(l[1:k - 1], chr(10)) ELSE text END) AS h FROM (SELECT record_id, text, string_split(text, chr(10)) AS l, coalesce(list_position(list_transform(string_split(text, chr(10)), lambda x: contains(lower(x), 'released under') OR contains(lower(x), 'copyright') OR contains(lower(x), 'idiot')), true), 0) AS k FROM rec)")
def _(v):
    return v.records.select("record_id", F.md5(T.cut_before(F.col("text"), PHRASES)).alias("h"))


@query("bm25_tokens", "SELECT record_id, len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))::BIGINT AS n FROM rec")
def _(v):
    return v.records.select("record_id", F.size(T.words(F.col("text"))).alias("n"))


@query("language_supported", "SELECT record_id, lang IN ('lt', 'en') AS programme_ok, lang IN ('lt', 'en', 'lv', 'et', 'pl', 'de', 'fr', 'nl', 'sv', 'es') AS job_ok FROM rec")
def _(v):
    return v.records.select("record_id", T.supported(F.col("lang"), "programme").alias("programme_ok"), T.supported(F.col("lang"), "job_ad").alias("job_ok"))


@query("html_text", None)
def _(v):
    return v.table("pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("html_tables", None)
def _(v):
    return v.table("pages").select("page_id", F.to_json(S.table_rows(F.col("html"))).alias("rows"))


# --- recommendations, dataset -------------------------------------------------

@query("market_trends", """SELECT uri, round(jobs / nj::DOUBLE, 6) AS demand, round(programmes / np_::DOUBLE, 6) AS supply, round(round(jobs / nj::DOUBLE - programmes / np_::DOUBLE, 9), 6) AS trend FROM (SELECT uri, count(DISTINCT record_id) FILTER (source_type = 'job_ad') AS jobs, count(DISTINCT record_id) FILTER (source_type = 'programme') AS programmes FROM skills JOIN rec USING (record_id) GROUP BY uri),
    (SELECT count(*) FILTER (source_type = 'job_ad') AS nj, count(*) FILTER (source_type = 'programme') AS np_ FROM rec) ORDER BY round(jobs / nj::DOUBLE - programmes / np_::DOUBLE, 9) DESC, uri LIMIT 50""")
def _(v):
    return R.market_trends(v.skills, v.records)


@query("top_gap_uris", "SELECT programme_id, array_to_string(list(gap_uri ORDER BY often DESC, gap_uri)[1:5], ',') AS gaps FROM (SELECT programme_id, gap_uri, count(*) AS often FROM gaps GROUP BY ALL) GROUP BY ALL")
def _(v):
    return R.top_gap_uris(v.gaps).select("programme_id", F.array_join("gaps", ",").alias("gaps"))


_PG = "(SELECT programme_id, job_id, array_to_string(list(gap_uri ORDER BY gap_weight DESC, gap_uri)[1:3], ',') AS gaps FROM gaps GROUP BY ALL)"


@query("recommendations", f"SELECT t.programme_id, t.job_id, t.rank, round(t.cosine, 5) AS score, 'semantic' AS strategy, coalesce(g.gaps, '') AS gaps FROM (SELECT *, row_number() OVER (PARTITION BY programme_id ORDER BY cosine DESC, job_id) AS rank FROM sem QUALIFY rank <= 10) t LEFT JOIN {_PG} g USING (programme_id, job_id)")
def _(v):
    rows = R.recommendations(v.nearest, "cosine", "semantic", v.gaps)
    return rounded(rows.withColumn("gaps", F.array_join("gaps", ",")), 5)


@query("export_mapping", f"SELECT t.programme_id, t.job_id, t.rank, round(t.weighted_jaccard, 6) AS score, coalesce(g.missing, '') AS missing FROM (SELECT *, row_number() OVER (PARTITION BY programme_id ORDER BY weighted_jaccard DESC, job_id) AS rank FROM sym QUALIFY rank <= 10) t LEFT JOIN (SELECT programme_id, job_id, array_to_string(list(preferred_label ORDER BY gap_weight DESC, gap_uri)[1:3], '; ') AS missing FROM gaps JOIN tax ON uri = gap_uri GROUP BY ALL) g USING (programme_id, job_id)")
def _(v):
    return R.export_mapping(v.symbolic_top(10), "weighted_jaccard", v.gaps, v.taxonomy.select("uri", "preferred_label"))


@query("text_length_stats", "SELECT round(avg(length(text)), 1) AS mean, round(quantile_cont(length(text), 0.5), 1) AS median, round(quantile_cont(length(text), 0.1), 1) AS p10, round(quantile_cont(length(text), 0.9), 1) AS p90, min(length(text)) AS min, max(length(text)) AS max FROM rec")
def _(v):
    return B.text_lengths(v.records)


@query("top_skills", "SELECT scope, preferred_label, count(*) AS n, row_number() OVER (PARTITION BY scope ORDER BY count(*) DESC, preferred_label) AS rank FROM (SELECT 'all' AS scope, preferred_label FROM skills UNION ALL SELECT source_type, preferred_label FROM skills JOIN rec USING (record_id)) GROUP BY scope, preferred_label QUALIFY rank <= 20")
def _(v):
    return B.top_skills(v.skills, v.records)


@query("coverage_rates", "SELECT source_type, count(*) AS n, round(avg(CASE WHEN record_id IN (SELECT record_id FROM skills) THEN 1.0 ELSE 0.0 END), 4) AS covered FROM rec GROUP BY ALL")
def _(v):
    return B.coverage_rate(v.records, v.skills)


@query("skills_per_record", "SELECT round(avg(n), 6) AS mean, median(n) AS median, count(*) FILTER (n = 0) AS n_empty, max(n) AS max FROM (SELECT record_id, count(uri) AS n FROM rec LEFT JOIN skills USING (record_id) GROUP BY ALL)")
def _(v):
    return B.skills_per_record(v.skills, v.records)


@query("lang_dist", "SELECT lang, source_type, count(*) AS n FROM rec GROUP BY ALL")
def _(v):
    return v.records.groupBy("lang", "source_type").agg(F.count("*").alias("n"))


@query("skill_tfidf", "SELECT record_id, uri, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY record_id)), 6) AS w FROM (SELECT record_id, uri, (1 + ln(1)) * (ln((1 + (SELECT count(*) FROM rec))::DOUBLE / (1 + df)) + 1) AS raw FROM skills JOIN idf USING (uri))")
def _(v):
    return B.skill_tfidf(v.skills, v.records)


@query("cluster_sizes", "SELECT cluster_label::BIGINT AS cluster_label, size, top FROM (SELECT cluster_label, count(*) AS size FROM clu GROUP BY ALL) LEFT JOIN (SELECT cluster_label, array_to_string(list(preferred_label ORDER BY n DESC, preferred_label)[1:5], ',') AS top FROM (SELECT cluster_label, preferred_label, count(*) AS n FROM clu JOIN skills USING (record_id) GROUP BY ALL) GROUP BY ALL) USING (cluster_label)")
def _(v):
    return B.cluster_sizes(v.clusters.select("record_id", "cluster_label"), v.skills)


query("kmeans_labels", None)(lambda v: B.kmeans_labels(v.vectors.select("record_id", "embedding"), 6))


for _algorithm in ("bisecting", "hdbscan", "agglomerative"):
    query(f"{_algorithm}_labels", None)(lambda v, a=_algorithm: C.fit_clusters(C.vector_features(v.vectors), a, 6))


@query("nearest_label", """WITH l AS (SELECT 'v' || record_id AS uri, embedding FROM vec JOIN rec USING (record_id) WHERE source_type = 'programme')
    SELECT c.record_id AS candidate_id, l.uri, round(list_cosine_similarity(c.embedding, l.embedding)::DOUBLE, 5) AS cosine FROM vec c, l QUALIFY row_number() OVER (PARTITION BY c.record_id ORDER BY round(list_cosine_similarity(c.embedding::DOUBLE[], l.embedding::DOUBLE[]), 9) DESC, l.uri) = 1""")
def _(v):
    own = v.records.where("source_type = 'programme'").select("record_id")
    labels = v.vectors.join(own, "record_id", "left_semi").select(F.concat(F.lit("v"), F.col("record_id").cast("string")).alias("uri"), "embedding")
    return rounded(V.best_labels(v.vectors.select(F.col("record_id").alias("candidate_id"), "embedding"), labels), 5)


# the other queries register themselves here
from . import grids, records  # noqa: E402, F401
