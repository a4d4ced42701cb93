import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from alidade.operators import clustering as C
from alidade.operators import vectors as V


def groups(labels):
    return {frozenset(np.flatnonzero(labels == k)) for k in set(labels) - {-1}}


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(4)
    return np.vstack([rng.normal(c, 0.1, (20, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 5))])


@pytest.mark.parametrize("linkage", C.LINKAGES)
def test_linkage_by_brute_force(linkage):
    points = np.random.default_rng(8).normal(size=(14, 2))
    sets = [frozenset([i]) for i in range(14)]

    def apart(a, b):
        d = [np.linalg.norm(points[i] - points[j]) for i in a for j in b]
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((points[list(a)].mean(0) - points[list(b)].mean(0)) ** 2).sum()
        return {"single": min, "complete": max, "average": np.mean}[linkage](d)

    while len(sets) > 4:
        a, b = min(itertools.combinations(sets, 2), key=lambda p: apart(*p))
        sets = [s for s in sets if s not in (a, b)] + [a | b]
    assert groups(C.cut(14, C.linkage_merges(points, linkage), 4)) == set(sets)


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        C.linkage_merges(np.zeros((2, 2)), "other")
    with pytest.raises(ValueError):
        C.fit_clusters(None, "other")


def test_spanning_tree_weight(blobs):
    n = len(blobs)
    d = np.sqrt(((blobs[:, None] - blobs[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 4]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    total = 0.0
    for w, i, j in sorted((reach[i, j], i, j) for i in range(n) for j in range(i)):
        if top(i) != top(j):
            parent[top(i)] = top(j)
            total += w
    assert sum(w for w, _, _ in C.spanning_tree(blobs, 5)) == pytest.approx(total)


def test_density_finds_groups_and_noise(blobs):
    points = np.vstack([blobs, [[20.0, 20.0, 20.0]]])
    labels = C.density_labels(points, 5)
    assert labels[-1] == -1
    # no label spans two blobs, and nearly all points have one
    assert all(len({i // 20 for i in g}) == 1 for g in groups(labels)) and (labels[:-1] >= 0).mean() > 0.8
    assert C.density_labels(np.zeros((1, 2)), 2).tolist() == [-1]


@pytest.mark.parametrize("algorithm", C.ALGORITHMS)
def test_each_algorithm_on_a_type(spark, blobs, algorithm):
    rows = [(i, "programme", [float(x) for x in p + 1]) for i, p in enumerate(blobs)] + [(900, "job_ad", [1.0, 2.0, 3.0]), (901, "programme", None)]
    df = spark.createDataFrame(rows, "record_id long, source_type string, embedding array<double>")
    out = {r.record_id: r.cluster_label for r in C.cluster_type(df, "programme", algorithm=algorithm, n_clusters=3, min_cluster_size=5).collect()}
    assert len(out) == len(rows) and out[900] is None and out[901] is None
    assert all(len({i // 20 for i in g}) == 1 for g in groups(np.array([out[i] for i in range(60)])))
    none = C.fit_clusters(C.vector_features(df.where("record_id < 0")), algorithm)
    assert none.count() == 0


def test_features(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "record_id long, embedding array<double>")
    got = {r.record_id: r.features.toArray().tolist() for r in C.vector_features(v).collect()}
    assert got[1] == pytest.approx([0.5**0.5] * 2) and got[2] == pytest.approx([0.6, 0.8])
    skills = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "record_id long, uri string")
    records = spark.createDataFrame([(1,), (2,), (3,)], "record_id long")
    rows = {r.record_id: r.features.toArray() for r in C.skill_features(skills, records).collect()}
    assert rows[2].tolist() == [1.0, 0.0] and np.linalg.norm(rows[1]) == pytest.approx(1) and not rows[3].any()
    assert {r.record_id for r in C.plane(C.vector_features(v)).collect()} == {1, 2}


def test_encoding_sections_and_chunks(spark):
    df = spark.createDataFrame([(1, "data data code"), (2, " "), (3, None)], "record_id long, text string")
    load = V.keyword_encoder(["data", "code"])
    got = {r.record_id: r.e for r in df.select("record_id", V.encode(F.col("text"), load, 2).alias("e")).collect()}
    assert got[1] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and got[2] == [0.0, 0.0] == got[3]
    s = spark.createDataFrame([(1, "skills", [1.0, 0.0]), (1, "other", [0.0, 1.0]), (2, "unknown", [1.0, 0.0])], "record_id long, section string, embedding array<double>")
    whole = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0])], "record_id long, embedding array<double>")
    mixed = {r.record_id: r.embedding for r in V.section_vectors(s, whole).collect()}
    assert mixed[1] == pytest.approx([0.25 / 0.065**0.5, 0.05 / 0.065**0.5]) and mixed[2] == [0.0, 1.0]
    c = V.word_chunks(spark.createDataFrame([(1, "a b c d e"), (2, "")], "record_id long, text string"), 2)
    assert sorted((r.record_id, r.at, r.chunk) for r in c.collect()) == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e")]
    pool = V.pooled(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "record_id long, embedding array<double>"))
    assert pool.first().embedding == pytest.approx([0.5**0.5] * 2)


def test_best_labels_in_blocks(spark):
    rng = np.random.default_rng(2)
    labels = [(f"u{i:02d}", rng.normal(size=4).tolist()) for i in range(30)] + [("u99", None)]
    own = [(i, rng.normal(size=4).tolist()) for i in range(10)] + [(77, None)]
    got = {r.candidate_id: r.uri for r in V.best_labels(spark.createDataFrame(own, "candidate_id long, embedding array<double>"), spark.createDataFrame(labels, "uri string, embedding array<double>"), 7).collect()}
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    assert got == {i: max(labels[:-1], key=lambda x: cos(v, x[1]))[0] for i, v in own[:-1]}
