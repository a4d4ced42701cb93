import math

import pytest
from pyspark.sql import functions as F

from alidade.operators import alignment as A
from alidade.operators import dedup as D
from alidade.operators import evaluation as E
from alidade.operators import recommendations as R
from alidade.operators import skills as K
from alidade.operators import tuning as P
from alidade.functions import text as T


def weights(spark, *rows):
    return spark.createDataFrame(list(rows), "record_id long, uri string, w double")


def test_set_scores_by_hand(spark):
    p = weights(spark, (1, "a", 1.0), (1, "b", 0.5))
    j = weights(spark, (7, "a", 0.5), (7, "c", 1.0), (8, "z", 1.0))
    pairs = spark.createDataFrame([(1, 7), (1, 8), (1, 9)], "programme_id long, job_id long")
    got = {r.job_id: r for r in A.set_scores(p, j, pairs).collect()}
    assert got[7].weighted_jaccard == pytest.approx(0.5 / 2.5)
    assert got[7].overlap_coeff == pytest.approx(0.5 / 1.5)
    assert got[7].programme_recall == pytest.approx(0.5 / 1.5)
    assert got[8].weighted_jaccard == got[9].weighted_jaccard == got[9].programme_recall == 0.0


def test_zero_and_missing_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "record_id long, embedding array<float>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 1)], "programme_id long, job_id long")
    got = {r.job_id: r.cosine for r in A.vector_scores(pairs, v).collect()}
    assert got == {2: 0.0, 3: None, 1: 1.0}


def test_alpha_outside_is_refused(spark):
    with pytest.raises(ValueError):
        A.hybrid(None, None, None, None, None, None, alpha=1.5)


def test_minmax_of_equal_scores_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.4), (2, 1, 0.1), (2, 2, 0.3)], "programme_id long, job_id long, s double")
    assert [r.m for r in df.select("programme_id", "job_id", A.minmax("s").alias("m")).orderBy("programme_id", "job_id").collect()] == [0.0, 0.0, 0.0, 1.0]


def test_uniform_weights_take_the_larger(spark):
    s = spark.createDataFrame([(1, "a", True), (1, "a", False), (1, " ", True), (2, "a", False)], "record_id long, uri string, explicit boolean")
    assert {(r.record_id, r.w) for r in K.uniform_weights(s).collect()} == {(1, 1.0), (2, 0.5)}


def test_rank_measures(spark):
    a = spark.createDataFrame([(1, k, float(k)) for k in range(5)], "programme_id long, job_id long, sa double")
    b = a.select("programme_id", "job_id", (-F.col("sa")).alias("sb"))
    assert E.spearman(a, b).first().rho == pytest.approx(-1.0)
    flat = a.select("programme_id", "job_id", F.lit(1.0).alias("sb"))
    assert E.spearman(a, flat).first().rho is None
    ra = a.select("programme_id", "job_id", F.col("job_id").alias("ra"))
    assert E.kendall(ra, ra.withColumnRenamed("ra", "rb")).first().tau == 1.0
    assert E.top_k_jaccard(a, a.withColumnRenamed("sa", "sb"), 3).first().jaccard == 1.0


def test_tails():
    assert E.wilcoxon_p(0, 5) == pytest.approx(2 / 32)
    assert E.chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    mean, low, high = E.bootstrap_ci([1.0, 2.0, 3.0, math.nan])
    assert low <= mean == 2.0 <= high


def test_best_strategy():
    assert R.best_strategy({"symbolic-semantic": 0.3, "symbolic-hybrid": 0.1, "semantic-hybrid": 0.2}) == "semantic"
    assert R.best_strategy({"symbolic-semantic": None}) == "hybrid"


def test_greedy_keeps_the_ends_of_a_chain(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "record_id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r.record_id for r in D.greedy_keep(ids, pairs).collect()} == {1, 3, 4}


def test_bands_lose_no_pair(spark):
    import random

    rng = random.Random(1)
    base = [rng.randrange(1 << 60) for _ in range(128)]
    rows = [(0, *base)]
    for k in range(1, 12):
        own = list(base)
        for i in rng.sample(range(128), 2 * k):
            own[i] = rng.randrange(1 << 60)
        rows.append((k, *own))
    df = spark.createDataFrame(rows, "record_id long, " + ", ".join(f"h{i} long" for i in range(128)))
    got = {(r.a, r.b) for r in D.near_pairs(df).collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and sum(p == q for p, q in zip(x[1:], y[1:])) / 128 >= 0.85}
    assert got == want


def test_signatures_match_brute_force(spark):
    from hashlib import md5

    from pyspark.sql import functions as F

    rows = [(1, "abcabcabd"), (2, "ab"), (3, None), (4, ""), (5, "é😀xyz" * 5000), (6, "abcabcabd")]
    df = spark.createDataFrame(rows, "record_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in D.signatures(df, F.col("text"), 4).collect()}
    want = {}
    for i, t in rows:
        grams = {t[a : a + 3] for a in range(len(t) - 2)} if t else set()
        want[i] = tuple(min((int(md5(f"{s}{g}".encode()).hexdigest()[:15], 16) for g in grams), default=0) for s in range(4))
    assert got == want
    assert D.signatures(df.limit(0), F.col("text"), 4).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("a  b\r\n\r\n\r\n\r\nc http://x.y/z d",), ("",), (None,)], "t string")
    got = [r.c for r in df.select(T.drop_urls(T.collapse_space("t")).alias("c")).collect()]
    assert got == ["a b\n\nc  d", "", None]
    s = spark.createDataFrame([("intro\nGoals:\nx\ny",)], "t string").select(T.sections(F.col("t")).alias("s")).first().s
    assert [(x.header, x.body) for x in s] == [("", "intro"), ("goals", "x\ny")]
    assert spark.createDataFrame([("<p>a&amp;b</p><p> c</p>",)], "t string").select(T.strip_html(F.col("t")).alias("x")).first().x == "a&b c"


def test_variants(spark):
    df = spark.createDataFrame([(0.25, 1.0)], "a double, b double")
    assert df.select(P.variant("geometric", 0.5, "a", "b").alias("v")).first().v == pytest.approx(0.5)
    assert df.select(P.variant("harmonic", 0.5, "a", "b").alias("v")).first().v == pytest.approx(0.4)
    with pytest.raises(ValueError):
        P.variant("other", 0.5, "a", "b")


def test_chain_of_three_levels(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until it is very tired of it all "
    near, far = base * 6, base * 3 + "and then something else entirely happens to the cat and to the bird in the tree " * 3
    rows = [(1, "u/a?x", near), (2, "U/A?y", far), (3, "u/b", near.upper()), (4, "u/c", near.replace("tired", "tiree")), (5, None, far), (6, None, None), (7, "", ""), (8, "u/a", "other")]
    df = spark.createDataFrame(rows, "record_id long, url string, text string")
    got = {r.record_id for r in D.deduplicated(df, F.col("url"), F.col("text"), ["record_id"]).collect()}
    signs = {r[0]: r[1:] for r in D.signatures(df, D.normalised(F.col("text"))).collect()}
    alike = lambda a, b: sum(x == y for x, y in zip(signs[a], signs[b])) / 128 >= 0.85
    kept, keys, prints, signed = [], set(), set(), []
    for i, url, text in rows:  # one by one, as the definition says
        key = (url or "").lower().split("?")[0]
        if key and key in keys:
            continue
        keys.add(key)
        if text:
            fp = " ".join(text.lower().split())
            if fp in prints:
                continue
            prints.add(fp)
            if any(alike(i, j) for j in signed):
                continue
            signed.append(i)
        kept.append(i)
    assert got == set(kept) and 4 not in got and {1, 5, 6, 7} <= got


def test_chunks_lose_nothing(spark):
    texts = ["One. Two two. " * 400, "word " * 900, "x" * 3000, "short", "", None]
    got = [r.c for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.chunks(F.col("t"), 1000).alias("c")).orderBy("k").collect()]
    for t, c in zip(texts, got):
        if t is None:
            assert c is None
        else:
            assert all(0 < len(x) <= 1000 for x in c) and "".join("".join(c).split()) == "".join(t.split())
    assert all(x.endswith(".") for x in got[0])


def test_records_are_read_and_written(spark, tmp_path):
    from alidade.sources import files as S

    assert S.read_records(spark, str(tmp_path / "none.json"), S.JOB).count() == 0
    rows = spark.createDataFrame([("Developer", "ACME", ["sql", "java"])], "title string, company string, required_skills array<string>")
    S.write_records(rows, str(tmp_path / "jobs"))
    back = S.read_records(spark, str(tmp_path / "jobs"), S.JOB).first()
    assert (back.title, back.company, back.required_skills, back.url) == ("Developer", "ACME", ["sql", "java"], None)
    at = tmp_path / "skills.csv"
    at.write_text('\ufeffconceptUri,skillType,reuseLevel,preferredLabel,altLabels,hiddenLabels,status,modifiedDate,scopeNote,definition,inScheme,description,code\nu1,s,r,"Java","Java\ncoffee ""code""",,,,,"a, b",,,1\n,s,r,none,,,,,,,,,2\n', encoding="utf-8")
    [r] = S.read_taxonomy(spark, str(at)).collect()
    assert (r.uri, r.preferred_label, r.alt_labels, r.description) == ("u1", "Java", ['coffee "code"'], "a, b")


def test_records_are_processed(spark):
    words = {"en": ["the", "and"], "lt": ["ir", "su"]}
    rows = [("About the job\nir su ir visi kiti labai geri darbai", " ", None), ("the work and the tools we use here", "  ", "What we offer\nmoney"), ("x", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = T.process_records(df, ["a", "b", "c"], "job_ad", words, html=False, translate=lambda t: F.lit("translated")).collect()
    assert [r.language for r in got] == ["en", "en", None] and got[0].cleaned_text == "translated" and got[2].cleaned_text is None
    assert got[0].language_confidence == 1.0 and got[2].tokens == [] and not got[2].language_supported
    marked = T.process_records(df, ["a"], "programme", words, marker="work", html=False).collect()[1]
    assert marked.cleaned_text == "and the tools we use here" and marked.tokens == ["tools", "we", "use", "here"]
