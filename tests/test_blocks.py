"""What is computed within cells, beside the plain definitions over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alidade.operators import alignment as A
from alidade.operators import blocks as B
from alidade.operators import evaluation as E
from alidade.operators import skills as K
from alidade.operators import tuning as P
from alidade.plans.views import Views

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, AT)


@pytest.fixture(scope="module")
def full(v):
    """Set scores by the join of all pairs, rounded as the queries round them."""
    scores = A.set_scores(*v.weights(), A.all_pairs(v.records))
    return scores.select(*A.PAIR, *(F.round(c, 9).alias(c) for c in A.MEASURES)).persist()


def rows(df, *names, digits=8):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_set_ranking_fills_zeros_without_joining_all_pairs(v, full):
    got = A.set_ranking(*v.weights(), v.records)
    assert rows(got, *A.PAIR, *A.MEASURES) == rows(full, *A.PAIR, *A.MEASURES)
    assert "CartesianProduct" not in plan(v.symbolic()) and "NestedLoop" not in plan(v.symbolic())


def test_coverage_needs_overlapping_pairs_only(v, full):
    names = ["programme_id", "n_matches", "match_share", "top_score", "mean_match", "low_coverage"]
    some = v.symbolic_some()
    assert 0 < some.count() < full.count()
    assert rows(E.coverage_of_some(v.records, some, "weighted_jaccard", 0.05), *names) == rows(E.coverage(v.records, full, "weighted_jaccard", 0.05), *names)
    with pytest.raises(ValueError):
        E.coverage_of_some(v.records, some, "weighted_jaccard", 0.0)


def test_summaries_count_zeros_and_bins(spark, v, full):
    names = ["n_pairs", "mean", "median", "max"]
    assert rows(A.set_summary(v.symbolic_some(), "weighted_jaccard", full.count()), *names) == rows(A.summary(full, "weighted_jaccard"), *names)
    for scores, zeros in (([0.5, 0.25, 0.125], 1), ([0.3], 0), ([0.2, 0.4], 0), ([0.2, 0.4], 2), ([0.000001, 0.7], 1), ([], 3)):
        some = spark.createDataFrame([(x,) for x in scores], "s double")
        every = sorted(scores + [0.0] * zeros)
        r = A.set_summary(some, "s", len(every)).first()
        assert (r.n_pairs, r.median, r.max) == (len(every), pytest.approx(np.median(every)), every[-1])
    assert A.set_summary(spark.createDataFrame([], "s double"), "s", 0).first().median is None
    sem = A.vector_blocks(*v.vector_sides())
    assert rows(A.vector_summary(*v.vector_sides()), *names) == rows(A.summary(sem, "cosine"), *names)


def test_spearman_of_vectors_with_ties_and_a_programme_without_skills(spark):
    rng = np.random.default_rng(5)
    v = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(40)]
    p, j = (spark.createDataFrame(part, "record_id long, embedding array<float>") for part in (v[:6], v[6:]))
    some = [(a, b, float(rng.integers(1, 4)) / 4) for a in range(5) for b in range(6, 40) if rng.random() < 0.5]
    some = spark.createDataFrame(some, "programme_id long, job_id long, sa double")
    pairs = A.all_pairs(p.withColumn("source_type", F.lit("programme")).unionByName(j.withColumn("source_type", F.lit("job_ad"))).drop("embedding"))
    whole = pairs.join(some, A.PAIR, "left").fillna(0.0, ["sa"])
    sem = A.vector_blocks(p, j).select(*A.PAIR, F.col("cosine").alias("sb"))
    want = {r.programme_id: r for r in E.spearman(whole, sem).collect()}
    got = {r.programme_id: r for r in E.spearman_of_vectors(some, p, j).collect()}
    assert set(got) == set(want) == set(range(6)) and got[5].rho is None and want[5].rho is None
    for k in range(5):
        assert got[k].rho == pytest.approx(want[k].rho, abs=1e-9) and got[k].shared == want[k].shared == 34


def test_stability_equals_kendall(spark, v):
    p, j = v.vector_sides()
    sample = E.resampled(j.select(F.col("record_id").alias("job_id")).distinct(), 2)
    full = v.ranked(A.vector_blocks(p, j), "cosine", "ra")
    again = full.join(sample, "job_id").withColumnRenamed("ra", "rb")
    want = E.kendall(full.join(sample, "job_id"), again, ("replicate", "programme_id"))
    assert rows(E.stability(p, j, sample, 2), "replicate", "programme_id", "tau") == rows(want, "replicate", "programme_id", "tau")
    for a in ([3, 1, 2], [0, 1, 2], [4, 3, 2, 1, 0], [2, 0, 1, 4, 3, 7, 5]):
        assert E.inversions(np.array(a)) == sum(x > y for i, x in enumerate(a) for y in a[i + 1 :])


def test_top_of_vectors_with_equal_scores(spark):
    rng = np.random.default_rng(3)
    v = [(k, [float(x) for x in rng.integers(-1, 2, 3)]) for k in range(1300)]
    p, j = (spark.createDataFrame(part, "record_id long, embedding array<float>") for part in (v[:20], v[20:]))
    top = A.vector_blocks(p, j, top=7)
    want = A.top_by(A.vector_blocks(p, j), 7, F.desc("cosine"), "job_id")
    assert rows(top, *A.PAIR, "cosine", "dot") == rows(want, *A.PAIR, "cosine", "dot")
    by_dot = A.top_by(A.vector_blocks(p, j), 7, F.desc("dot"), "job_id")
    assert rows(A.vector_blocks(p, j, top=7, by="dot"), *A.PAIR, "dot") == rows(by_dot, *A.PAIR, "dot")


def test_vectors_are_copied_to_a_fixed_number_of_cells():
    assert [B.blocks(n, 12) for n in (0, 1, 512, 513, 6_000, 10**9)] == [1, 1, 1, 2, 12, 12]


def test_top_diversity_of_some_equals_that_of_all(v, full):
    names = ["config", "diversity_1", "jobs_5", "cov", "mean"]
    score = [F.lit("a").alias("config"), *A.PAIR, F.col("weighted_jaccard").alias("s")]
    want = P.top_diversity(full.select(*score), "s", ("config",))
    assert rows(P.top_diversity_of_some(A.with_zeros(*v.weights(), v.records, 5).select(*score), "s", *v.sizes), *names) == rows(want, *names)


def test_words_of_a_repeated_record_count_once(spark, tmp_path):
    text = "wordone wordone wordtwo"
    docs = [(k, text, "en", "src0" if k < 2 else "src1", len(text)) for k in (0, 0, 1, 2, 3, 4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    v = Views(spark, str(tmp_path))
    assert rows(v.taxonomy, "preferred_label") == [("wordone",), ("wordtwo",)]
    assert rows(v.skills, "record_id", "preferred_label", "tf")[:2] == [(0, "wordone", 4), (0, "wordtwo", 2)]


def test_matches_make_no_runs_longer_than_a_label(spark):
    texts = spark.createDataFrame([(1, "a b c a b")], "record_id long, text string")
    labels = spark.createDataFrame([("a b", "u"), ("c", "w")], "label_lc string, uri string")
    got = K.dictionary_matches(texts, labels, F.split("text", " "), longest=8)
    assert rows(got, "record_id", "uri", "hits") == [(1, "u", 2), (1, "w", 1)]
    # runs of one and two words: one transform makes the pairs
    assert got._jdf.queryExecution().analyzed().toString().count("transform(") == 1


def test_near_pairs_send_no_signatures_to_all_tasks(spark):
    from alidade.operators import dedup as D

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, (30, D.WIDTH))
    signs = []
    for k in range(300):
        s = base[k % 30].copy()
        s[rng.permutation(D.WIDTH)[: rng.integers(0, 30)]] = rng.integers(0, 2**60)
        signs.append((k, *map(int, s)))
    df = spark.createDataFrame(signs, ", ".join(["record_id long", *(f"h{i} long" for i in range(D.WIDTH))]))
    m = np.array([s[1:] for s in signs])
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if (m[a] == m[b]).mean() >= 0.85}
    copies = {(a, b) for a, b in want if (m[a] == m[b]).all()}
    got = D.near_pairs(df)
    pairs = {(r.a, r.b): r.similarity for r in got.collect()}
    assert want - copies and all(pairs[p] == pytest.approx((m[p[0]] == m[p[1]]).mean()) for p in pairs)
    least = {k: min(x for x in range(300) if (m[x] == m[k]).all()) for k in range(300)}
    assert set(pairs) == {(a, b) for a, b in want if least[b] == b and least[a] == a or least[b] == a}
    # s is wide: neither side of a join may be broadcast
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_linkage_and_density_trees_of_more_rows_than_one_process_takes(spark, monkeypatch):
    from alidade.operators import clustering as C

    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(c, 0.3, (60, 4)) for c in (0, 3, 6)] + [rng.normal(0, 4, (20, 4))])
    near = [round(w, 9) for w, _, _ in C.spanning_tree(points, 5)]
    assert [round(w, 9) for w, _, _ in C.spanning_tree_rounds(spark, points, 5)] == near
    ward = C.linkage_merges(points, "ward")
    got = C.ward_merges(spark, points, alone=50)
    assert [round(m[0], 9) for m in got] == [round(m[0], 9) for m in ward]
    assert C.cut(200, got, 5).tolist() == C.cut(200, ward, 5).tolist()
    df = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)], "record_id long, embedding array<double>")
    for algorithm in ("hdbscan", "agglomerative"):
        whole = rows(C.fit_clusters(C.vector_features(df), algorithm, 4), "record_id", "cluster_label")
        monkeypatch.setattr(C, "MOST_LINKED", 100)
        assert rows(C.fit_clusters(C.vector_features(df), algorithm, 4), "record_id", "cluster_label") == whole
        monkeypatch.undo()
