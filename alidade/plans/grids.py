"""Queries of grids, bundles and whole-run measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import evaluation as E
from ..operators import recommendations as R
from ..operators import tuning as P
from . import catalogue as base
from .catalogue import query

REBALANCE = [round(0.3 + 0.025 * k, 3) for k in range(17)]
GRID_ALPHAS = [round(0.05 * k, 2) for k in range(21)]


def _table(name: str, values) -> str:
    return f"(SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in values)}]) AS {name})"


# --- best alpha: the highest mean correlation with both pure rankings -----------

def _rank(score: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {score} DESC) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0::DOUBLE"


_RHOS = f"""SELECT alpha, programme_id, {{other}} AS kind, CASE WHEN count(*) >= 3 AND count(*) * sum(ra * ra) - sum(ra) ** 2 > 1e-9 AND count(*) * sum(rb * rb) - sum(rb) ** 2 > 1e-9 THEN (count(*) * sum(ra * rb) - sum(ra) * sum(rb)) / sqrt((count(*) * sum(ra * ra) - sum(ra) ** 2) * (count(*) * sum(rb * rb) - sum(rb) ** 2)) END AS rho
    FROM (SELECT alpha, programme_id, {_rank('sa', 'alpha, programme_id')} AS ra, {_rank('{column}', 'alpha, programme_id')} AS rb FROM (SELECT *, round(alpha * cosine + (1 - alpha) * wj, 9) AS sa FROM cand, {_table('alpha', base.ALPHAS)})) GROUP BY alpha, programme_id"""
_SWEEP = "SELECT alpha, round(avg(rho) FILTER (kind = 'sym'), 6) AS rho_sym, round(avg(rho) FILTER (kind = 'sem'), 6) AS rho_sem FROM (" + _RHOS.format(other="'sym'", column="wj") + " UNION ALL " + _RHOS.format(other="'sem'", column="cosine") + ") GROUP BY alpha"


def _sweep(v):
    rows = P.with_grid(v.candidates, "alpha", base.ALPHAS).withColumn("sa", F.round(P.mixed("alpha", "cosine", "wj"), 9))
    keys = ["alpha", "programme_id"]
    own = rows.select(*keys, *(E.average_rank(c, *keys).alias(f"r_{c}") for c in ("sa", "cosine", "wj")))
    rho = lambda c: F.when(F.count("*") >= 3, E.pearson("r_sa", f"r_{c}"))
    by = own.groupBy(*keys).agg(rho("wj").alias("sym"), rho("cosine").alias("sem"))
    return by.groupBy("alpha").agg(F.round(F.avg("sym"), 6).alias("rho_sym"), F.round(F.avg("sem"), 6).alias("rho_sem"))


query("alpha_correlations", _SWEEP)(_sweep)
query("best_alpha", f"SELECT alpha, rho_sym, rho_sem FROM ({_SWEEP}) ORDER BY rho_sym + rho_sem DESC, alpha LIMIT 1")(lambda v: _sweep(v).orderBy(F.desc(F.col("rho_sym") + F.col("rho_sem")), "alpha").limit(1))


# --- rebalance: the whole hybrid at each alpha, of the stages that don't depend on it once ---

_DIVERSE = """SELECT {keys}, round(count(DISTINCT job_id) FILTER (place = 1) / count(DISTINCT programme_id)::DOUBLE, 6) AS diversity_1, count(DISTINCT job_id) FILTER (place <= 5) AS jobs_5, round(stddev_samp(score) / avg(score), 6) AS cov, round(avg(score), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, programme_id ORDER BY score DESC, {order}job_id) AS place FROM {rows}) GROUP BY {keys}"""
_REBALANCED = f"""(WITH m AS (SELECT alpha, programme_id, job_id, cosine, round(alpha * c0 * confidence + (1 - alpha) * r, 9) AS mixed FROM normed, {_table('alpha', REBALANCE)}), o AS (SELECT alpha, job_id, count(DISTINCT programme_id) AS often FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY alpha, programme_id ORDER BY mixed DESC, cosine DESC, job_id) <= 30) GROUP BY ALL),
    i AS (SELECT m.*, CASE WHEN coalesce(often, 1) >= greatest(2, floor(n_programmes * 0.5)) THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS f, ln(1 + n_programmes::DOUBLE / coalesce(often, 1)) AS ipf FROM m LEFT JOIN o USING (alpha, job_id), np)
    SELECT alpha, programme_id, job_id, cosine, round(mixed * coalesce(f + (1 - f) * (ipf - min(ipf) OVER (PARTITION BY alpha)) / nullif(max(ipf) OVER (PARTITION BY alpha) - min(ipf) OVER (PARTITION BY alpha), 0), 1.0), 9) AS score FROM i)"""


def _rebalanced(v):
    p, j = v.weights("programme_idf")
    rows = P.with_grid(A.hybrid_parts(v.nearest, p, j, v.skills, v.idf), "alpha", REBALANCE)
    rows = rows.withColumn("mixed", F.round(P.mixed("alpha", "c", "r"), 9))
    rows = A.frequency_penalty(rows, "mixed", v.n_programmes, 30, keys=("alpha",), extra_order=(F.desc("cosine"),))
    return rows.select("alpha", "programme_id", "job_id", "cosine", F.round(F.col("mixed") * F.col("penalty"), 9).alias("score"))


query("alpha_rebalance", _DIVERSE.format(keys="alpha", order="", rows=_REBALANCED))(lambda v: P.top_diversity(_rebalanced(v), "score", ("alpha",)))
query("alpha_rebalance_best", f"SELECT alpha, diversity_1, cov FROM ({_DIVERSE.format(keys='alpha', order='', rows=_REBALANCED)}) ORDER BY diversity_1 DESC, cov DESC, alpha LIMIT 1")(
    lambda v: base.rounded(P.top_diversity(_rebalanced(v), "score", ("alpha",))).select("alpha", "diversity_1", "cov").orderBy(F.desc("diversity_1"), F.desc("cov"), "alpha").limit(1)
)


# --- formula grid: variants by alphas, one job ----------------------------------

_VARIANTS = {
    **{f"linear_{b}": f"(alpha * cosine + (1 - alpha) * wj) * (1 + {b}::DOUBLE * (1 - abs(cosine - wj)))" for b in (0.0, 0.1, 0.2, 0.3)},
    **{f"rank_{b}": f"(alpha * rc + (1 - alpha) * rw) * (1 + {b}::DOUBLE * (1 - abs(rc - rw)))" for b in (0.0, 0.1, 0.2, 0.3)},
    "geometric": "pow(greatest(cosine, 1e-6), alpha) * pow(greatest(wj, 1e-6), 1 - alpha)",
    "harmonic": "1 / (alpha / greatest(cosine, 1e-6) + (1 - alpha) / greatest(wj, 1e-6))",
}
_PLACED = "(SELECT *, coalesce(({0} - 1) / nullif(count(*) OVER (PARTITION BY programme_id) - 1, 0), 0) AS rc, coalesce(({1} - 1) / nullif(count(*) OVER (PARTITION BY programme_id) - 1, 0), 0) AS rw FROM cand)".format(
    *(f"rank() OVER (PARTITION BY programme_id ORDER BY {c}) + (count(*) OVER (PARTITION BY programme_id, {c}) - 1) / 2.0::DOUBLE" for c in ("cosine", "wj"))
)
_GRID = f"(SELECT programme_id, job_id, alpha, unnest([{', '.join(repr(k) for k in _VARIANTS)}]) AS variant, unnest([{', '.join(f'round({x}, 9)' for x in _VARIANTS.values())}]) AS score FROM {_PLACED}, {_table('alpha', GRID_ALPHAS)})"


@query("formula_grid", _DIVERSE.format(keys="variant, alpha", order="", rows=_GRID))
def _(v):
    rows = v.candidates.select("*", P.rank_norm("cosine", "programme_id").alias("rc"), P.rank_norm("wj", "programme_id").alias("rw"))
    rows = P.with_grid(rows, "alpha", GRID_ALPHAS)
    each = [(f"{kind}_{b}", P.variant("linear", F.col("alpha"), x, y, b)) for kind, x, y in (("linear", "cosine", "wj"), ("rank", "rc", "rw")) for b in (0.0, 0.1, 0.2, 0.3)]
    each += [(kind, P.variant(kind, F.col("alpha"), "cosine", "wj")) for kind in ("geometric", "harmonic")]
    scored = rows.select("programme_id", "job_id", "alpha", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.round(s, 9).alias("score")) for n, s in each))).alias("e"))
    return P.top_diversity(scored.select("programme_id", "job_id", "alpha", "e.variant", "e.score"), "score", ("variant", "alpha"))


# --- comparison of two configurations of the hybrid -----------------------------

@query("impact_comparison", "SELECT config, " + _DIVERSE.format(keys="config", order="", rows="(SELECT 'symbolic' AS config, programme_id, job_id, weighted_jaccard AS score FROM sym UNION ALL SELECT 'programme_idf', programme_id, job_id, weighted_jaccard FROM sym_pidf)").removeprefix("SELECT config, "))
def _(v):
    both = [A.with_zeros(*v.weights(k), v.records, 5).select(F.lit(n).alias("config"), "programme_id", "job_id", F.col("weighted_jaccard").alias("score")) for n, k in (("symbolic", "uniform"), ("programme_idf", "programme_idf"))]
    return P.top_diversity_of_some(both[0].unionAll(both[1]), "score", *v.sizes)


# --- all pairs of strategies, coverage at k, significance -----------------------

_SCORES = {"sym": ("sym", "weighted_jaccard"), "sem": ("sem", "cosine"), "hyb": ("hyb", "hybrid_score")}
_PAIRS = [("sym", "sem"), ("sym", "hyb"), ("sem", "hyb")]


def _top(name: str, k: int) -> str:
    t, s = _SCORES[name]
    return f"(SELECT programme_id, list(job_id) AS l FROM (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY {s} DESC, job_id) <= {k}) GROUP BY ALL)"


query("jaccard_all_pairs", " UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, {k}::BIGINT AS k, programme_id, round(len(list_intersect(coalesce(x.l, []), coalesce(y.l, [])))::DOUBLE / greatest(1, len(list_distinct(list_concat(coalesce(x.l, []), coalesce(y.l, []))))), 6) AS jaccard FROM {_top(a, k)} x FULL JOIN {_top(b, k)} y USING (programme_id)" for a, b in _PAIRS for k in (5, 10)))(
    lambda v: E.union_all([E.top_k_jaccard(*(v.rankings[n][0].withColumnRenamed(v.rankings[n][1], c) for n, c in ((a, "sa"), (b, "sb"))), k).select(F.lit(f"{a}-{b}").alias("pair"), F.lit(k).cast("bigint").alias("k"), "programme_id", "jaccard") for a, b in _PAIRS for k in (5, 10)])
)
query("coverage_at_k", " UNION ALL ".join(f"SELECT '{n}' AS strategy, {k}::BIGINT AS k, round(count(DISTINCT job_id) / (SELECT count(*) FROM rec WHERE source_type = 'job_ad')::DOUBLE, 6) AS coverage FROM (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY {s} DESC, job_id) <= {k})" for n, (t, s) in _SCORES.items() for k in (5, 10)))(
    lambda v: E.union_all([E.coverage_at_k(df, s, v.records, k).select(F.lit(n).alias("strategy"), F.lit(k).cast("bigint").alias("k"), "coverage") for n, (df, s) in v.rankings.items() for k in (5, 10)])
)


def _mean_top(name: str) -> str:
    t, s = _SCORES[name]
    return f"(SELECT programme_id, avg({s}) AS m FROM (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY {s} DESC, job_id) <= 10) GROUP BY ALL)"


query("significance", " UNION ALL ".join(f"""SELECT '{a}-{b}' AS pair, n, statistic, CASE WHEN n >= 3 THEN round(1 - 2 * statistic / (n * (n + 1) / 2.0::DOUBLE), 6) END AS effect, mean FROM (SELECT count(*) FILTER (d <> 0) AS n, CASE WHEN count(*) FILTER (d <> 0) >= 3 THEN least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE END AS statistic, round(avg(d), 6) AS mean
    FROM (SELECT d, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE END AS r FROM (SELECT round(x.m - y.m, 9) AS d FROM {_mean_top(a)} x JOIN {_mean_top(b)} y USING (programme_id))))""" for a, b in _PAIRS))(
    lambda v: E.union_all([E.paired(E.mean_top_scores(*v.rankings[a]), E.mean_top_scores(*v.rankings[b])).select(F.lit(f"{a}-{b}").alias("pair"), "*") for a, b in _PAIRS])
)
query("safe_means", "SELECT record_id % 10 AS k, round(avg(CASE WHEN record_id % 3 <> 0 THEN length(text) END), 6) AS mean FROM rec GROUP BY ALL")(
    lambda v: v.records.groupBy((F.col("record_id") % 10).alias("k")).agg(R.safe_mean(F.when(F.col("record_id") % 3 != 0, F.length("text").cast("double")).otherwise(F.lit(float("nan")))).alias("mean"))
)

_CLUSTERED = " UNION ALL ".join(f"SELECT cluster_label::BIGINT AS cluster_label, '{n}' AS strategy, count(*) AS n, round(avg(m), 6) AS mean FROM {_mean_top(n)} JOIN clu ON record_id = programme_id GROUP BY cluster_label" for n in _SCORES)
query("cluster_bundle", _CLUSTERED)(
    lambda v: E.union_all([E.mean_top_scores(df, s).join(v.clusters, F.col("record_id") == F.col("programme_id")).groupBy("cluster_label").agg(F.count("*").alias("n"), F.avg("mean_top").alias("mean")).select("cluster_label", F.lit(n).alias("strategy"), "n", "mean") for n, (df, s) in v.rankings.items()])
)
