import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alidade.llm import decontamination, language_model, mixing, near_copies, pages, quality, secrets, simhash, tokens, toxicity, urls

AT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, key string"
ODD = ["", None, "\n \t", "a", "x y", "é", "token = 'abcdefghijkl'", "same text here now", "same text here now", "AKIA" + "Z9" * 10, "deadbeef" * 3, "z" * 5000, "w " * 5000]


def odd(spark):
    rows = [(k, t, None, None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "fp", 3, "key") for k, t in enumerate(ODD)]
    rows += [rows[7], (None, "no id", "en", "s0", 5, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{AT}/documents.parquet")


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_secrets_against_regular_expressions(spark, docs):
    both = docs.select("doc_id", "text").unionByName(odd(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text").where("doc_id is not null").distinct())
    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    got = {r.doc_id: r for r in secrets.find_secrets(both, secrets.default_ratios(spark)).select("doc_id", secrets.joined(F.col("__base")).alias("b"), secrets.joined(F.col("__spans")).alias("s")).collect()}
    for k, t in texts(both).items():
        own = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 12]
        own += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
        own += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
        assert got[k].b == ",".join(f"{secrets.KINDS[k_]}:{a}:{b}" for a, k_, b in sorted(own))
        assert set(got[k].b.split(",")) <= set(got[k].s.split(",")) | {""}


def held_out_runs():
    """Runs of key characters from neither the samples' rule nor their words:
    digests and encodings, and names of the standard library."""
    import base64
    import hashlib
    import importlib
    import secrets as system

    keys = []
    for k in range(200):
        raw = hashlib.sha512(str(k).encode()).digest()
        keys += [base64.b64encode(raw[:18]).decode(), base64.urlsafe_b64encode(raw[18:45]).decode(), base64.b32encode(raw[:20]).decode(), raw[40:60].hex(), system.token_urlsafe(24)]
    names = set()
    for module in "os socket http.client email.message unittest.mock asyncio concurrent.futures logging.handlers xml.etree.ElementTree urllib.request ssl subprocess tarfile zipfile decimal argparse".split():
        for name in dir(importlib.import_module(module)):
            names |= {name, f"{module}.{name}", name.replace("_", "-")}
    return keys, sorted(n for n in names if len(n) >= 16)


def test_markov_models_tell_random_from_ordinary(spark, docs):
    ratios = secrets.default_ratios(spark)
    keys, names = held_out_runs()
    own = spark.createDataFrame([(k, 1) for k in keys] + [(n, 0) for n in names], "sample string, label int")
    scored = own.select("label", "sample", (secrets.ratio(F.col("sample"), F.lit(ratios)) >= secrets.MARGIN).alias("hit")).collect()
    rate = lambda label: sum(r.hit for r in scored if r.label == label) / sum(r.label == label for r in scored)
    assert len(names) > 300 and rate(1) > 0.97 and rate(0) < 0.02, [r.sample for r in scored if r.hit != r.label][:30]


def test_a_key_around_a_base_span_is_found_whole(spark):
    ratios = secrets.default_ratios(spark)
    key = "AbC9xQ7zLm2K" + "0123456789abcdef0123" + "Rt5YuI8oPz4WqX"
    rows = [(1, f"see {key} here"), (2, "x " + "Zq7Kp0Vw9sLx4TtB" + " and the_name_of_a_function_that_is_long"), (3, "token = 'kJ8s0Wq2Lz5Xv7Nb'"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in secrets.find_secrets(df, ratios).select("doc_id", secrets.joined(F.col("__spans")).alias("s")).collect()}
    assert got == {1: f"markov:4:{4 + len(key)},hex:16:36", 2: "markov:2:18", 3: "assign:0:25", 4: ""}
    assert {r.doc_id: r.text for r in secrets.redact(df, ratios).collect()}[1] == "see [SECRET] here"


def test_many_overlapping_spans_become_few_cuts(spark):
    text = " ".join(["AKIA" + "Z9" * 10, "word", "deadbeef" * 3, "a" * 20] * 300)
    out = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), secrets.default_ratios(spark)).first().text
    assert out == " ".join(["[SECRET] word [SECRET] [SECRET]"] * 300)


def test_redaction_keeps_rows_and_columns(spark):
    df = odd(spark)
    out = secrets.redact(df, secrets.default_ratios(spark))
    assert out.columns == df.columns and out.count() == df.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[6].text == "[SECRET]'" and got[6].n_chars == 9 and got[1].text is None and got[7].text == ODD[7]


def test_token_counts_equal_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = odd(spark).unionByName(spark.createDataFrame([(50, "a<|endoftext|>b don't é x y 1234" + "7a" * 9000, None, None, 0, None, None, None)], SCHEMA))
    both = docs.limit(60).select("doc_id", "text").union(more.select("doc_id", "text"))
    rows = both.collect()
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in tokens.count_tokens(both, public_tokenizers.path("word_bpe_49k.json")).collect()}
    for r in rows:
        x = r.text or ""
        assert got[(r.doc_id, len(x.encode()))] == len(t.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_decontamination_by_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items = spark.read.parquet(f"{AT}/benchmark.parquet").union(spark.createDataFrame([(900, "x y"), (901, None), (902, ""), (900, "x y")], "item_id long, text string"))
    both = docs.select("doc_id", "text").union(odd(spark).select(F.col("doc_id") + 10**6, "text").where("doc_id is not null").distinct())
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for r in items.collect():
        w = low(r.text)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(r.item_id))
    got = {r.doc_id: r for r in decontamination.contamination(both, items).collect()}
    kept = {r.doc_id for r in decontamination.clean_documents(both, items).collect()}
    n = 0
    for k, t in texts(both).items():
        w, hit, found = low(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    hit |= set(range(a, a + size))
                    found |= windows[tuple(w[a : a + size])]
        assert (got[k].n_words, sum(b - a for a, b in zip(got[k].starts, got[k].ends)), sorted(got[k].items)) == (len(w), len(hit), sorted(found))
        assert (k in kept) == (not hit)
        n += bool(hit)
    assert n > 2 and decontamination._blocks(items)[1] > (1 if block == 3000 else 0)


def test_index_holds_all_terms(spark, docs):
    index = decontamination.build_index(docs)
    own = Counter(w for t in texts(docs).values() for w in decontamination.words_of(t.encode()))
    rows = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("t.terms", "t.counts").collect()
    got = Counter()
    for r in rows:
        got[bytes(r[0])] += r[1]
    assert got == own
    some = set(list(own)[:500]) | {b"absent"}
    assert decontamination.frequencies(index, some) == {w: own[w] for w in some if own[w]}


def test_quality_statistics_by_brute_force(spark, docs):
    both = docs.select("doc_id", "text").union(odd(spark).select(F.col("doc_id") + 10**6, "text").where("doc_id is not null").distinct())
    got = {r.doc_id: r for r in quality.judge(both).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for k, t in texts(both).items():
        w = word.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often, lines = Counter(grams), [x for x in t.split("\n") if word.search(x)]
        covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_model_by_plain_em():
    import math
    import random

    rng, rows = random.Random(2), Counter()
    right = [(0.9, 0.2), (0.95, 0.5), (0.8, 0.3), (0.99, 0.7)]
    for _ in range(3000):
        good = rng.random() < 0.8
        rows[tuple(0 if rng.random() < 0.2 else 1 if rng.random() < (a if good else b) else -1 for a, b in right)] += 1
    each = [p for p in sorted(rows) for _ in range(rows[p])]
    post = [(p.count(1) + 1) / (4 - p.count(0) + 2) for p in each]
    for _ in range(120):  # a row at a time
        share = (sum(post) + 3) / (len(post) + 4)
        keep = []
        for r in range(4):
            own = [(p[r], g) for p, g in zip(each, post) if p[r]]
            keep.append([(sum(g for v, g in own if v == 1) + 3.2) / (sum(g for _, g in own) + 4), (sum(1 - g for v, g in own if v == 1) + 1.6) / (sum(1 - g for _, g in own) + 4)])
        odds = [math.prod([share / (1 - share), *((a if v == 1 else 1 - a) / (b if v == 1 else 1 - b) for v, (a, b) in zip(p, keep) if v)]) for p in each]
        post = [o / (1 + o) for o in odds]
    got = quality.fit(sorted(rows.items()), 120)
    assert got[0] == pytest.approx(share, abs=1e-6) and got[1] == [pytest.approx(tuple(k), abs=1e-6) for k in keep]
    assert abs(share - 0.8) < 0.05


def test_quality_verdicts_come_from_em(spark):
    at = "/root/testdata/sf0.01"
    rows = quality.judge(spark.read.parquet(f"{at}/documents.parquet")).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id", "left").collect()
    every, rows = rows, [r for r in rows if not r.base_failed]
    names = [f"vote_{k}" for k in quality.votes()]
    patterns = sorted(Counter(tuple(r[n] for n in names) for r in rows).items())
    start = quality.fit(patterns, 0)
    before = {p: quality._posterior(p, *start) >= 0.5 for p, _ in patterns}
    assert sum(before[tuple(r[n] for n in names)] != r.kept for r in rows) > 20  # rounds change verdicts
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) > 0.99 * len(good) and sum(bad) < 0.1 * len(bad)
    single = [r.posterior >= quality.THRESHOLD for r in every if sum(r[n] == -1 for n in names) == 1]
    assert any(single)  # one reject vote can be outvoted


def test_repeated_words_of_very_long_texts(spark, monkeypatch):
    text = " ".join(f"a{k % 7} b{k % 11} c" for k in range(900)) + " x y z"
    df = spark.createDataFrame([(1, text), (2, "p q r s t u v w x y z " * 2), (3, " ".join(f"w{k}" for k in range(700)))], "doc_id long, text string")
    want = {r.doc_id: r.n_repeat_words for r in quality.statistics(df).collect()}
    monkeypatch.setattr(quality, "PLACE_BITS", 9)  # beyond 512 windows places no longer fit
    assert {r.doc_id: r.n_repeat_words for r in quality.statistics(df).collect()} == want and want[3] == 0 and want[1] > 0


def test_mix_meets_its_targets(spark, docs):
    rows = mixing.pareto_mix(docs, mixing.one_two_three).collect()
    again = {(r.doc_id, r.taken) for r in mixing.pareto_mix(docs.repartition(3), mixing.one_two_three).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    by, largest, target = Counter(), Counter(), {}
    for r in rows:
        assert r.taken <= 3 * r.size
        by[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        target[r.source] = r.target
    assert all(abs(by[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    sizes = {r.doc_id: r.size for r in rows}
    assert all(sizes[k] == len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in texts(docs).items())


def test_inclusion_follows_document_weights(spark):
    import math

    sizes = [(10, 400), (100, 60), (1000, 8)]
    rows = [(k * 1000 + i, "w " * n, "a") for k, (n, many) in enumerate(sizes) for i in range(many)] + [(9000 + i, "v " * 50, "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    weight = lambda rank: F.when(rank == 0, 1.0).otherwise(2.0)
    target = sum(n * many for n, many in sizes) + 5000 - 15000  # b stops at three times its words
    by, often, seeds = Counter(), Counter(), range(6)
    for seed in seeds:
        got = mixing.pareto_mix(df, weight, seed).where("source = 'a'").collect()
        assert got[0].target == target and abs(sum(r.taken for r in got) - target) <= 500
        for r in got:
            by[r.size] += r.copies
            often[r.size] += 1
    scale = target / sum(n * many * mixing.LONGER ** math.log10(n) for n, many in sizes)
    want = {n: scale * mixing.LONGER ** math.log10(n) for n, _ in sizes}
    assert want[10] < want[100] < want[1000] < 1
    for n in want:
        p, m = want[n], often[n]
        assert abs(by[n] / m - p) < 4 * math.sqrt(p * (1 - p) / m) + 0.02, (n, by[n] / m, p)


def test_whole_copies_are_certain_and_capped(spark):
    rows = [(k, "w " * 10 ** (1 + k % 3), "a") for k in range(90)] + [(100 + k, "v " * 5000, "b") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.pareto_mix(df, lambda rank: F.when(rank == 0, 9.0).otherwise(1.0), document_weight=lambda size: F.when(size == 10, None).otherwise(size)).collect()
    mine = [r for r in got if r.source == "a"]
    target = mine[0].target
    assert abs(sum(r.taken for r in mine) - target) <= 500 and max(r.copies for r in mine) <= 3
    # copies follow the weights: the longest are repeated most
    mean = lambda n: sum(r.copies for r in mine if r.size == n) / 30
    assert mean(10) <= mean(100) <= mean(1000) and min(r.copies for r in mine if r.size == 1000) >= 1


def test_mix_of_rows_alike(spark):
    rows = [(None, "a b c", "s")] * 50 + [(7, "d e f", "s")] * 50 + [(None, None, None)] * 20 + [(8, "x " * 100, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("theirs")).withColumn("size", F.lit(1))
    got = mixing.pareto_mix(df, mixing.one_two_three).collect()
    assert len(got) == len(rows)
    for s in ("s", "t"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
    out = mixing.mixed_documents(df, mixing.one_two_three)
    assert out.columns == ["doc_id", "text", "source", "size", "copies", "taken"]
    assert sorted((r.source, r.taken) for r in out.collect()) == sorted((r.source, r.taken) for r in got if r.copies)
    assert mixing.mixed_documents(df.limit(0), mixing.one_two_three).count() == 0


def test_targets_stop_and_share_again(spark):
    df = spark.createDataFrame([("a", 1), ("b", 100), ("c", 1)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df, mixing.one_two_three).collect()}
    assert got == pytest.approx({"a": 3.0, "b": 96.0, "c": 3.0})


def plain_fingerprint(text):
    """The contract's fingerprint, bit by bit."""
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_by_brute_force(spark, docs):
    both = docs.select("doc_id", "text").union(odd(spark).select(F.col("doc_id") + 10**6, "text").where("doc_id is not null").distinct())
    own = {k: plain_fingerprint(t) for k, t in texts(both).items()}
    parent = {k: k for k in own}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (own[a] ^ own[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(both).collect()}
    assert got == {k: (f"{f:016x}", top(k)) for k, f in own.items()}


def test_tree_finds_what_a_scan_finds():
    import random

    rng = random.Random(3)
    tree, held = simhash.BKTree(), []
    base = rng.getrandbits(64)
    for _ in range(400):
        v = base
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64)
        if v not in held:
            assert sorted(tree.add_and_find(v, 2)) == sorted(x for x in held if (x ^ v).bit_count() <= 2)
            held.append(v)


def test_links_of_a_large_group_have_no_hub():
    values = sorted({1 << a | 1 << b for a in range(40) for b in range(a, 40)} | {0})
    found = simhash.spanning_links(values, 2)
    often = Counter(x for pair in found for x in pair)
    assert len(found) == len(values) - 1 and max(often.values()) <= simhash.FAN + 1


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {900: 900, 901: 900}


def test_one_of_each_keeps_repeated_rows_once(spark):
    out = simhash.one_of_each(odd(spark))
    assert [r.doc_id for r in out.where("text = 'same text here now'").collect()] == [7]
    assert out.columns == odd(spark).columns


def test_one_of_each_loses_no_text(spark):
    a, b, c, d = ("one text of its own", "another text that stands alone", "a third one without a copy", "number four, which nobody repeats")
    rows = spark.createDataFrame([(None, a), (None, b), (7, c), (7, d), (7, d), (9, c), (None, a)], "doc_id long, text string")
    for found in (None, near_copies.near_copies(rows)):
        kept = sorted(((r.doc_id or -1), r.text) for r in simhash.one_of_each(rows, found).collect())
        assert kept == sorted([(-1, a), (-1, b), (7, c), (7, d)])
    assert simhash.one_of_each(rows.limit(0)).count() == 0


def test_proximity_without_an_items_rarest_words(spark):
    words = [f"w{k}" for k in range(30)]
    items = spark.createDataFrame([(1, " ".join(["absent", *words, "nowhere", "never"])), (2, "q1 q2 q3 q4 q5")], "item_id long, text string")
    held = [
        " ".join(["x"] * 30 + words[6:12] + ["y"] + words[14:16] + ["x"] * 30),  # a reworded part
        " ".join(w for k in range(30) for w in [words[k], *["x"] * 9]),  # too far apart
        "q5 x q1 x q3 q2", "q5 x q1 q3", "x",
        " ".join(["x"] * 5 + words[:4]), " ".join(words[4:8] + ["x"] * 5),  # beyond a document's end
        " ".join(words),
    ]
    rows = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.near for r in decontamination.contamination(rows, items).collect()}
    assert got == {0: ["1"], 1: [], 2: ["2"], 3: [], 4: [], 5: [], 6: [], 7: ["1"]}


def test_near_copies_by_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = " ".join(f"w{k}" for k in range(60)).split()
    edits = [" ".join(words[:at] + ["other"] + words[at + 1 :]) for at in (0, 20, 40, 59)] + [" ".join(words[:20] + words[40:])]
    both = d.union(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(edits)], "doc_id long, text string"))
    sets = {}
    for k, t in texts(both).items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    holders, parent = {}, {k: k for k in sets}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    pairs = {(a, b) for own in holders.values() if len(own) < 200 for a in own for b in own if a < b}
    empty = sorted(k for k, s in sets.items() if not s)
    pairs |= set(zip(empty, empty[1:]))
    n = 0
    for a, b in pairs:
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            n += sets[a] != sets[b]
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    assert n > 12
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(both).collect()} == {k: top(k) for k in sets}


def test_near_copies_are_found_by_simhash_too(spark):
    words = [f"w{k}" for k in range(4000)]
    texts_ = [" ".join(words), " ".join([*words, "more"]), " ".join(words[2000:]), " ".join(f"x{k}" for k in range(4000)), "", "a b", None]
    d = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    rows = near_copies._keyed(d)
    sets = [near_copies.shingles((t or "").encode()) for t in texts_]
    sims = [simhash.of_hashes(s) for s in sets]
    for own, sim in zip(sets, sims):
        votes = [sum(int(x) >> bit & 1 for x in own) for bit in range(64)]
        assert sim == sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(own))
    assert (sims[0] ^ sims[1]).bit_count() <= 2 < min((sims[0] ^ sims[k]).bit_count() for k in (2, 3))
    fp = {r.doc_id: r.fp for r in rows.collect()}
    key = {r.fp: r.key for r in near_copies.simhash_buckets(rows).collect()}
    assert key.keys() == {fp[k] for k in (0, 1, 2, 3, 5)} and key[fp[0]] == key[fp[1]] and len(set(key.values())) == 4
    # with no key in common, SimHash alone leads to the link
    alone = rows.withColumn("keys", F.when(F.size("keys") > 0, F.array("fp")).otherwise(F.col("keys")))
    assert [{r.a, r.b} for r in near_copies._links(d, alone).collect()] == [{fp[0], fp[1]}]


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (0, 7818)")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, AT).collect()] == [0]


def test_near_copies_of_odd_rows(spark):
    for df in (odd(spark), spark.createDataFrame([], SCHEMA)):
        assert near_copies.near_copies(df).count() == df.count()
    out = simhash.one_of_each(odd(spark), near_copies.near_copies(odd(spark)))
    assert [r.doc_id for r in out.where("text = 'same text here now'").collect()] == [7]
    assert [r.doc_id for r in out.where("text is null or trim(text) = ''").collect()] == [0]


def test_toxicity_on_held_out_rows(spark):
    at = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = toxicity.toxicity(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://A.Example.com/en/7x?y", ("a.example.com", "/en/7x", "example.com/en/7", "allow")),
        ("http://x.com/en/1#z", ("x.com", "/en/1", "com/en/", "block")),
        ("https://m.example.net/de/81", ("m.example.net", "/de/81", "example.net/de/8", "block")),
        ("https://notcom/en/1", ("notcom", "/en/1", None, "allow")),
        ("no scheme", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
    ],
)
def test_listed_url_rules(spark, url, want):
    r = urls.filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), labelled=spark.createDataFrame([], "url string, block boolean")).first()
    assert (r.host, r.path, r.rule, r.verdict) == want


def test_mined_rules_match_their_tokens_only(spark):
    seen = [(f"http://a{i}.spam.org/x/{i}", True) for i in range(50)] + [(f"http://a{i}.fine.org/x/{i}", False) for i in range(50)] + [(None, True), ("http://a.spam.org/", None)]
    own = spark.createDataFrame([(1, "http://b.spam.org/y"), (2, "http://b.fine.org/y"), (3, "http://b.spam.org/es/1"), (4, "http://b.spam.example.net/de/1"), (5, "")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in urls.filter_urls(own, labelled=spark.createDataFrame(seen, "url string, block boolean")).collect()}
    # a mined rule decides where no listed one does, and only there
    assert got == {1: ("block", True), 2: ("allow", False), 3: ("block", True), 4: ("allow", True), 5: ("allow", False)}


def test_mined_rules_of_long_urls(spark):
    deep = "/".join(f"d{k}" for k in range(60))
    seen = [(f"http://a.org/{deep}/{'bad' if i % 2 else 'good'}/{i}?k{i % 3}=1", bool(i % 2)) for i in range(80)]
    own = [(1, f"http://b.net/{deep}/bad/7"), (2, f"http://b.net/{deep}/good/7"), (3, "http://b.net/bad")]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(own, "page_id long, url string"), labelled=spark.createDataFrame(seen, "url string, block boolean")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_rule_matching_by_brute_force(spark):
    import random

    rng = random.Random(8)
    rules = [(tuple(sorted(rng.sample("abcdefghij", rng.randint(1, 3)))), 1.0) for _ in range(25)]
    rows = [(k, rng.sample("abcdefghijklm", rng.randint(0, 6))) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    got = {r.k: r.hit for r in df.select("k", urls.matches(F.col("t"), rules).alias("hit")).collect()}
    assert got == {k: any(set(r) <= set(t) for r, _ in rules) for k, t in rows}


def test_mined_rules_by_brute_force(spark):
    from itertools import combinations

    at = "/root/testdata/sf0.01"
    p, labels = spark.read.parquet(f"{at}/pages.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    known = urls.listed_labels(p).unionAll(urls.document_labels(p, labels))
    rows = [(frozenset(r.t), r.block) for r in known.select(urls.tokens(F.col("url")).alias("t"), "block").collect()]
    assert max(len(t) for t, _ in rows) <= urls.MINED_WIDTH
    least, want = max(urls.SUPPORT, urls.LEAST_ROWS / len(rows)) * len(rows), {}
    for size in (1, 2, 3):
        often, bad = Counter(), Counter()
        for t, block in rows:
            for c in combinations(sorted(t), size):
                often[c] += 1
                bad[c] += block
        for c, n in bad.items():
            if n >= least and n / often[c] >= urls.CONFIDENCE and not any(x in want for k in range(1, size) for x in combinations(c, k)):
                want[c] = n / often[c]
    assert want and dict(urls.mine(known)) == pytest.approx(want)


def test_page_text():
    html = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav>m</nav><div class="ad">x</div><article><h1>T &amp; U</h1><p>a <b>b</b><br>c<p>d<aside>no</aside></article><footer>f'
    assert pages.content(html) == "T & U\na b c\nd"
    assert pages.content("") == "" and pages.content("plain <i>text</i>") == "plain text"


def test_page_text_of_odd_markup():
    assert pages.content('<body class="has-sidebar"><p>hello there</p></body>') == "hello there"
    assert pages.content('<div class="entry-header"><h1>T</h1></div><div class="entry-content"><p class="side note">x <y is small</p><p>and more</p></div>') == "T\nx <y is small\nand more"
    assert pages.content('<article><p>text <a href="x') == "text"
    assert pages.content("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert pages.content("<table><tr><td>1</td><td>2</td></tr></table><p>3") == "1\n2\n3"
    assert pages.content('<body><nav>a</nav><article></article><div class="ad">buy this</div></body>') == ""


def test_page_scan_is_linear():
    import time

    def took(text):
        began = time.process_time()
        pages.content(text)
        return time.process_time() - began

    for piece in ("<a ", "<!x", '<a b="', "<a b='<a c=\"", "<i>", "<p>", "</div>", "<div>", "<!--", "<script>"):
        assert took(piece * 40_000) < 2, piece


def _site(k, layout="plain"):
    words = lambda n, seed: " ".join(f"w{(seed * 31 + i * i) % 997}" for i in range(n))
    head = "<div><a href=/>Home</a> <a href=/x>News of the day</a></div>"
    body = f"<h1>{words(4, k)}</h1><p>{words(60, k)}</p><h2>Background</h2><p>{words(40, k + 500)}</p><p>Sign up for our letter today</p>"
    tail = "<div>All rights reserved by us</div>"
    if layout == "plain":
        return f"<body>{head}<div>{body}</div><div>{words(6, k + 900)}</div>{tail}</body>"
    return f"<body><table><tr><td>{head}{tail}</td><td><div class=x{k}>{body}</div></td></tr></table></body>"


def _wanted(k):
    return [x for x in re.sub("<[^>]*>", "\n", _site(k)[_site(k).index("<h1>") : _site(k).index("Sign up")]).split("\n") if x]


def test_wrappers_decide_where_names_say_nothing():
    wrapper = pages.induce([_site(k) for k in range(8)] + [_site(99, "table")])
    assert len(wrapper) == 2
    for k in (3, 50, 77):
        assert pages.content(_site(k), wrapper, {}).split("\n") == _wanted(k)
        assert pages.content(_site(k), pages._unpacked(pages._packed(wrapper)), {}).split("\n") == _wanted(k)
    # one page of another layout spoils nothing; alone, it can't know its constants
    assert pages.content(_site(4, "table"), wrapper, {}).split("\n") == [*_wanted(4), "Sign up for our letter today"]


def test_copies_of_an_article_do_not_become_template():
    same = [f"<body><nav>{k}</nav><article><p>{'share us with all the others ' * 9}</p></article><footer>{k}</footer></body>" for k in range(8)]
    assert pages.content(same[0], pages.induce(same), {}) == " ".join(["share us with all the others"] * 9)
    varied = [f"<body><article><p>share us</p><p>own {k}</p></article></body>" for k in range(6)]
    assert pages.content(varied[0], pages.induce(varied), {}) == "own 0"


def test_wrappers_count_all_pages_of_a_host(spark):
    def page(k, line, n):
        words = " ".join(f"w{k * k + i}" for i in range(n))
        return f"<body><div>Home</div><div><h1>t {k}</h1><p>{line}</p><p>{words}</p></div><div>All rights</div></body>"

    # a line that is one in the small pages varies in the others, which are the most
    rows = [(k, f"http://a.org/{k}", page(k, "one line" if k < 12 else f"line {k}", 60 if k < 12 else 5000)) for k in range(40)]
    rows += [(100, "http://b.org/", None), (101, None, page(1, "x", 30))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in pages.extract(df).collect()}
    assert all(got[k][:2] == [f"t {k}", "one line" if k < 12 else f"line {k}"] and len(got[k]) == 3 for k in range(40))
    assert got[100] == [""] and got[101][-1].startswith("w1 ")
    a, b = ({r.host: bytes(r.wrapper) for r in pages.templates(x).collect()} for x in (df.coalesce(1), df.union(df).repartition(7)))
    assert a == b and set(a) == {"a.org", ""}


def test_tree_matching_against_its_definition():
    import random

    rng = random.Random(4)

    def grown(depth):
        node = pages.Shape(rng.choice("ab"))
        if depth:
            node.children = [grown(depth - 1) for _ in range(rng.randint(0, 3))]
        return node

    def most(a, b):
        if a.name != b.name:
            return 0
        m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children, 1):
            for j, y in enumerate(b.children, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + most(x, y))
        return 1 + m[-1][-1]

    for _ in range(200):
        a, b = grown(4), grown(4)
        pairs = pages.matched(a, b)
        assert len(pairs) == most(a, b) and all(x.name == y.name for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_wrappers_decide_most_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = lambda u: u.split("/")[2]
    of = {r.host: pages._unpacked(bytes(r.wrapper)) for r in pages.templates(table).collect()}
    rows = table.collect()
    fits = sum(pages.roles(of[host(r.url)], pages.shape(pages.parse(r.html)))[0] for r in rows)
    assert fits >= 0.95 * len(rows)
    from html import unescape

    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(table).collect()}
    for r in rows:
        inner = r.html[r.html.index("<article>") : r.html.rindex("</article>")]
        lines = re.sub("<[^>]*>", "", re.sub("</?(?:p|h1)>", "\n", inner.replace("<br>", " "))).split("\n")
        want = "\n".join(x for x in (" ".join(unescape(t).split()) for t in lines) if x)
        assert got[r.page_id] == (want, len(want))


def test_language_model_beats_unigrams_and_scores_repeats_apart(spark):
    import math

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    few = d.where("doc_id % 25 = 3")
    once = {r.doc_id: r for r in language_model.score(d).collect()}
    counts = Counter(w for t in texts(d).values() for w in t.encode().translate(language_model.LOWER).split())
    n = sum(counts.values())
    unigram = sum(c * math.log(c / n) for c in counts.values()) / n
    assert sum(r.n_tokens for r in once.values()) == n
    assert sum(r.log_likelihood for r in once.values()) / n > unigram + 0.2
    # documents that occur twice in the corpus score higher than when they occurred once
    twice = {r.doc_id: r for r in language_model.score(d.unionAll(few.select(F.col("doc_id") + 10**6, "text"))).collect()}
    again = [k for k in twice if k >= 10**6 and twice[k].n_tokens > 50]
    assert len(again) > 20 and all(twice[k].mean_log_likelihood == pytest.approx(twice[k - 10**6].mean_log_likelihood) for k in again)
    rise = {k: twice[k].mean_log_likelihood - once[k].mean_log_likelihood for k in once if once[k].n_tokens > 50}
    doubled = sorted(rise[k - 10**6] for k in again)
    others = sorted(v for k, v in rise.items() if k + 10**6 not in twice)
    assert doubled[len(doubled) // 10] > others[len(others) * 9 // 10]


def test_language_model_does_not_depend_on_the_layout(spark, docs, monkeypatch):
    monkeypatch.setattr(language_model, "GROUP_BYTES", 1 << 16)  # some groups
    monkeypatch.setattr(language_model, "SALT_GROUPS", 2)
    both = docs.select("doc_id", "text").unionAll(odd(spark).select(F.col("doc_id") + 10**6, "text"))
    a, b = ({r.doc_id: r.log_likelihood for r in language_model.score(df).collect()} for df in (both.coalesce(1), both.repartition(7)))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-4, abs=1e-4) for k in a)


def test_shares_known_where_texts_are_encoded_and_joined_ones_agree(spark, docs, monkeypatch):
    both = docs.select("doc_id", "text").unionAll(odd(spark).select(F.col("doc_id") + 10**6, "text"))
    found = []
    for most in (0, 2000, 10**6):
        monkeypatch.setattr(language_model, "KNOWN", most)
        model, rows = language_model.train(both)
        joined = rows.agg(F.sum(F.size("rare"))).first()[0]
        found.append((len(model.known[0]), joined, {r.doc_id: r.log_likelihood for r in language_model.score(both, model).collect()}))
    (none, every, a), (few, some, b), (all_, left, c) = found
    assert none == 0 < few <= 2000 < all_ and every > some > left == 0
    assert all(a[k] == pytest.approx(b[k]) == pytest.approx(c[k]) for k in a) and a.keys() == b.keys() == c.keys()


def test_log_probabilities_by_brute_force():
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    flat = rng.normal(0, 0.4, len(language_model.Network().flat())).astype(np.float32)
    net = language_model.Network(flat)
    rows = [rng.integers(0, language_model._SIZE, n).astype(np.uint16) for n in (7, 0, 1, 12)]
    ids, starts, sizes = language_model.joined([r.tobytes() for r in rows])
    got = net.log_probabilities(ids, np.flatnonzero(ids >= 0))
    want = []
    for r in rows:
        for i, w in enumerate(r):
            near = [int(r[i + o]) if 0 <= i + o < len(r) else -1 for o in (-2, -1, 1, 2)]
            h = [*np.tanh(sum(net.inputs[k][x].astype(float) for k, x in enumerate(near))), 1.0]
            p = [math.exp(np.dot(net.classes[c], h)) for c in range(language_model.CLASSES)]
            c, k = divmod(int(w), language_model.WORDS)
            q = [math.exp(np.dot(net.words[c][x], h)) for x in range(language_model.WORDS)]
            want.append(math.log(p[c] / sum(p)) + math.log(q[k] / sum(q)))
    assert list(got) == pytest.approx(want, abs=1e-3) and [int(s) for s in sizes] == [7, 0, 1, 12]
    apart = np.array([[0.0, 1.0], [-500.0, -500.5], [300.0, 299.0]], np.float32)
    assert list(language_model._log_softmax_at(apart.copy(), np.array([1, 0, 0]))) == pytest.approx([-math.log(1 + math.exp(-1)), -math.log(1 + math.exp(-0.5)), -math.log(1 + math.exp(-1))], abs=1e-4)
    assert language_model._softmax(apart.copy()).sum(1) == pytest.approx([1, 1, 1])
    every = [tuple(language_model.masked(99, 50, t)) for t in range(language_model.STEP)]
    assert sorted(x for e in every for x in e) == list(range(50))  # rounds mask different places


def test_training_predicts_every_token_once(monkeypatch):
    import numpy as np

    places = []
    monkeypatch.setattr(language_model.Network, "learn", lambda self, ids, at, rate: places.append(ids[at]))
    flat = language_model.Network().flat()
    rows = [(h, np.arange(n, dtype=np.uint16).tobytes()) for h, n in ((99, 50), (-7, 0), (3, 1), (12, 700))]
    n = sum(language_model.group_change(rows, flat, turn)[0] for turn in range(language_model.ROUNDS))
    assert n == 751 and sorted(np.concatenate(places)) == sorted([*range(50), 0, *range(700)])


def test_words_are_split_and_counted_as_bytes_are(spark, docs, monkeypatch):
    import pyarrow as pa

    plain = lambda t: (t or "").encode().translate(language_model.LOWER).split()
    own = [*ODD, " a  B\x0b\x0c\x1cc\u00a0\u00c9 \u0130 ", "\r\nx\x00Y\x85 \x1f z\t", *texts(docs).values()]
    for column in (pa.array(own), pa.array(own).slice(3, 9), pa.array(own, pa.large_string()), pa.array([], pa.string())):
        words, codes, edges = language_model.split_words(column)
        words = words.to_pylist()
        assert [[words[c] for c in codes[a:b]] for a, b in zip(edges[:-1], edges[1:])] == [plain(t) for t in column.to_pylist()]
    monkeypatch.setattr(language_model, "SLICE", 3000)
    parts = list(language_model.text_slices(pa.RecordBatch.from_arrays([pa.array(own)], ["text"]), 0))
    assert len(parts) > 5 and [t for p in parts for t in p.column(0).to_pylist()] == own
    df = spark.createDataFrame([(t,) for t in own], "text string").repartition(3)
    want = Counter(w for t in own for w in plain(t))
    for most in (20, 400_000):  # sums are sent early, or at the end
        monkeypatch.setattr(language_model, "HELD_WORDS", most)
        assert {bytes(r.word): r.n for r in language_model.word_counts(df).collect()} == want


def test_words_cost_less_than_one_look_up_each(docs):
    import time

    import pyarrow as pa

    own = pa.array([*texts(docs).values()] * 20)

    def by_word():
        held = Counter()
        for t in own.cast(pa.binary()).to_pylist():
            held.update(t.translate(language_model.LOWER).split())
        return held

    def cpu(work):
        at = time.thread_time()
        work()
        return time.thread_time() - at

    assert min(cpu(lambda: language_model.split_words(own)) for _ in range(7)) < 0.8 * min(cpu(by_word) for _ in range(7))


def test_a_training_step_by_brute_force():
    import numpy as np

    m = language_model
    rng = np.random.default_rng(5)
    net = m.Network(rng.normal(0, 0.4, len(m.Network().flat())).astype(np.float32))
    ids, _, _ = m.joined([rng.integers(0, 130, n).astype(np.uint16).tobytes() for n in (9, 1, 40)])
    at, rate = np.flatnonzero(ids >= 0)[::2], 0.3
    inputs, classes, words = (x.astype(float) for x in (net.inputs, net.classes, net.words))
    into, to_class, to_word = np.zeros_like(inputs), np.zeros_like(classes), np.zeros_like(words)
    met = Counter(int(ids[i]) // m.WORDS for i in at)
    for i in at:
        near = [int(ids[i + o]) for o in (-2, -1, 1, 2)]
        h = np.append(np.tanh(sum(inputs[k][x] for k, x in enumerate(near))), 1)
        c, k = divmod(int(ids[i]), m.WORDS)
        p, q = np.exp(classes @ h), np.exp(words[c] @ h)
        p, q = p / p.sum() - (np.arange(m.CLASSES) == c), q / q.sum() - (np.arange(m.WORDS) == k)
        to_class += np.outer(p, h) / len(at) ** 0.5
        to_word[c] += np.outer(q, h) / met[c] ** 0.5
        back = ((p @ classes + q @ words[c]) * (1 - h**2))[:-1]
        for place, x in enumerate(near):
            into[place][x] += np.clip(back, -1, 1)
    net.learn(ids, at, rate)
    assert np.allclose(net.classes, classes - rate / 2 * np.clip(to_class, -1, 1), atol=1e-4)
    assert np.allclose(net.words, words - rate / 2 * np.clip(to_word, -1, 1), atol=1e-4)
    assert np.allclose(net.inputs, inputs - rate / 2 * into, atol=1e-4)


def test_nulls_ties_and_empty_tables(spark):
    import public_tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    for df in (odd(spark), spark.createDataFrame([], SCHEMA)):
        n = df.count()
        assert tokens.count_tokens(df, file).count() == n
        assert decontamination.contamination(df, items).count() == n
        assert quality.judge(df).count() == n
        assert mixing.pareto_mix(df, mixing.one_two_three).count() == n
        assert simhash.near_duplicates(df).count() == n
        assert toxicity.toxicity(df, labels).count() == n
        assert language_model.score(df).count() == n
        assert secrets.find_secrets(df, [0.0] * 67 * 67).count() == n
        p = df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), F.lit("c").alias("host"))
        assert pages.extract(p).count() == n and urls.filter_urls(p).count() == n


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{AT}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d.count()
        d = stage(spark, d, AT)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < d.count() <= before, name
    mix = corpus_pipeline.run(spark, AT)
    assert mix.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "taken"]
    rows, before = mix.collect(), {r.doc_id: r.text for r in d.collect()}
    assert rows and all(before[r.doc_id] == r.text and 1 <= r.copies <= 3 and r.taken == r.copies * len(r.text.split()) for r in rows)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    for df in (odd(spark), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, AT)
            assert set(df.columns) <= set(out.columns), name
            kept = Counter(r.text for r in out.select("text").collect())
            if name in ("toxicity", "decontamination", "secrets"):
                assert out.count() == df.count(), name
            elif name == "near_duplicates" and df.count():
                assert kept["no id"] == 1 and kept["same text here now"] == 1 and kept["z" * 5000] == 1
