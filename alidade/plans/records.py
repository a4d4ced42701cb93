"""Queries of preprocessing, de-duplication, sources and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import alignment as A
from ..operators import dedup as D
from ..operators import skills as K
from ..sources import files as S
from .catalogue import query
from .views import kept

# Lines put behind the documents, by turn, so that every rule meets its case.
TAILS = [
    "Share this job\n12\nreal words follow us here\n- - -",
    "about the JOB\nwork\nWhat we offer\nmoney",
    "We use cookies on this site\n---\nSee https://x.example/a?b now",
    "Siųsti CV\n Salary : 1000 \nthe end",
    "Goals:\nlearn python and SQL\n\nTools we use daily:\nJava, Docker\nEqual opportunity employer here",
    "a b​c é\n<b>bold</b> tail\nCopyright © us",
]
STOP_WORDS = {"en": ["the", "and", "of", "to", "in"], "de": ["der", "die", "und", "nicht", "ein"], "fr": ["le", "la", "les", "des", "que"], "es": ["el", "los", "de", "con", "para"]}
PATTERN = "|".join(f"(?:{p})" for p in T.BOILERPLATE)
EXCLUDED = [("red", "en"), ("src3", "fr")]
TARGETS = ["land", "ia"]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TAILS = "[" + ", ".join(quoted(t) for t in TAILS) + f"][1 + record_id % {len(TAILS)}]"
POSTS = f"(SELECT *, text || chr(10) || {_TAILS} AS post FROM rec)"


def posts(v):
    tail = F.get(F.array(*(F.lit(t) for t in TAILS)), F.pmod("record_id", F.lit(len(TAILS))).cast("int"))
    return v.records.withColumn("post", F.concat("text", F.lit("\n"), tail))


def sql_space(t: str) -> str:
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A[ \\n\\t\\r]+|[ \\n\\t\\r]+\\z', '', 'g')"


def sql_lines(t: str) -> str:
    cut = f"regexp_split_to_array({t}, {quoted(T.LINE_ENDS.replace(chr(0x85), chr(0x85)))})"
    return f"list_slice({cut}, 1, len({cut}) - CASE WHEN {cut}[-1] = '' THEN 1 ELSE 0 END)"


def sql_boilerplate(t: str) -> str:
    return f"array_to_string(list_filter({sql_lines(t)}, lambda x: NOT regexp_matches(trim(x), {quoted(PATTERN)}, 'i')), chr(10))"


def sql_nfc(t: str) -> str:
    return f"replace(replace(replace(replace(nfc_normalize({t}), chr(160), ' '), chr(8203), ''), chr(8204), ''), chr(65279), '')"


def sql_urls(t: str) -> str:
    return f"regexp_replace({t}, 'https?://[^ \\t\\n\\r]+', '', 'g')"


def sql_post(t: str) -> str:
    cut = " OR ".join(f"regexp_matches(x, {quoted(p)}, 'i')" for p in T.POST_CUTOFFS)
    lines = sql_lines(t)
    place = f"coalesce(list_position(list_transform({lines}, lambda x: {cut}), true), 0)"
    return f"array_to_string(list_filter(CASE WHEN {place} > 0 THEN list_slice({lines}, 1, {place} - 1) ELSE {lines} END, lambda x: NOT regexp_matches(x, {quoted(T.POST_HEADER)}, 'i')), chr(10))"


def sql_language(t: str) -> str:
    own = f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"
    counts = {k: f"len(list_intersect({own}, {ws}))" for k, ws in STOP_WORDS.items()}
    best = "list_max([" + ", ".join(f"{{'n': {c}, 'language': '{k}'}}" for k, c in sorted(counts.items())) + "])"
    return best, "(" + " + ".join(counts.values()) + ")"


query("boilerplate_lines", f"SELECT record_id, md5({sql_boilerplate('post')}) AS h FROM {POSTS}")(lambda v: posts(v).select("record_id", F.md5(T.drop_boilerplate(F.col("post"))).alias("h")))
query("nfc_text", f"SELECT record_id, md5({sql_nfc('post')}) AS h FROM {POSTS}")(lambda v: posts(v).select("record_id", F.md5(T.nfc(F.col("post"))).alias("h")))
query("post_tail", f"SELECT record_id, md5({sql_post('post')}) AS h, len({sql_post('post')}) AS n FROM {POSTS}")(lambda v: posts(v).select("record_id", F.md5(T.strip_post(F.col("post"))).alias("h"), F.length(T.strip_post(F.col("post"))).alias("n")))
query("after_marker", "SELECT record_id, md5(CASE WHEN strpos(text, '. ') > 0 THEN ltrim(substr(text, strpos(text, '. ') + 2)) ELSE text END) AS h FROM rec")(lambda v: v.records.select("record_id", F.md5(T.after_marker(F.col("text"), ". ")).alias("h")))
_CLEAN = sql_space(sql_urls(sql_boilerplate(sql_space(sql_nfc("post")))))
query("clean_text", f"SELECT record_id, CASE WHEN length(t) >= 200 THEN md5(t) END AS h, CASE WHEN length(t) >= 200 THEN length(t) END AS n FROM (SELECT record_id, {_CLEAN} AS t FROM {POSTS})")(
    lambda v: posts(v).select("record_id", T.clean(F.col("post"), 200).alias("t")).select("record_id", F.md5("t").alias("h"), F.length("t").alias("n"))
)

_BEST, _TOTAL = sql_language("text")


@query("language_tags", f"SELECT record_id, language, round(coalesce(confidence, 0), 3)::DOUBLE AS confidence, coalesce(language IN ('lt', 'en'), false) AS supported FROM (SELECT record_id, CASE WHEN ok THEN b.language END AS language, CASE WHEN ok THEN b.n / total::DOUBLE END AS confidence FROM (SELECT record_id, {_BEST} AS b, {_TOTAL} AS total, length(trim(text)) >= 20 AND {_TOTAL} > 0 AS ok FROM rec))")
def _(v):
    tag = T.tag_language(F.col("text"), STOP_WORDS, "programme")
    return v.records.select("record_id", tag.alias("t")).select("record_id", "t.language", "t.confidence", "t.supported")


_STOP = sorted({w for ws in STOP_WORDS.values() for w in ws})
_TOKENS = "list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda w: NOT list_contains(" + str(_STOP) + ", w))"
query("record_tokens", f"SELECT record_id, len({_TOKENS.format(t='text')}) AS n, md5(array_to_string({_TOKENS.format(t='text')}, ' ')) AS h FROM rec")(lambda v: v.records.select("record_id", T.tokens(F.col("text"), STOP_WORDS).alias("t")).select("record_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("h")))

_ALL = sql_space(sql_urls(sql_boilerplate(sql_space(sql_nfc("concat_ws(' ', CASE WHEN regexp_matches(source, '\\S') THEN source END, CASE WHEN regexp_matches(post, '\\S') THEN post END)")))))
_B2, _T2 = sql_language("c")


@query("record_processor", f"""WITH a AS (SELECT record_id, {_ALL} AS t FROM {POSTS}), b AS (SELECT record_id, CASE WHEN length(t) >= 30 THEN {sql_post('t')} END AS c FROM a)
    SELECT record_id, md5(c) AS h, CASE WHEN length(trim(c)) >= 20 AND {_T2} > 0 THEN {_B2}.language END AS language, coalesce(CASE WHEN length(trim(c)) >= 20 AND {_T2} > 0 THEN {_B2}.language END IN ('lt', 'en', 'lv', 'et', 'pl', 'de', 'fr', 'nl', 'sv', 'es'), false) AS supported, len({_TOKENS.format(t='c')}) AS n FROM b""")
def _(v):
    rows = T.process_records(posts(v), ["source", "post"], "job_ad", STOP_WORDS, html=False)
    return rows.select("record_id", F.md5("cleaned_text").alias("h"), T.tag_language(F.col("cleaned_text"), STOP_WORDS, "job_ad")["language"].alias("language"), F.col("language_supported").alias("supported"), F.size("tokens").alias("n"))


query("text_chunks", None)(lambda v: v.records.select("record_id", F.posexplode(T.chunks(F.col("text"), 1000)).alias("at", "c")).select("record_id", "at", F.length("c").alias("n"), F.md5("c").alias("h")))


@query("section_parse", f"""WITH l AS (SELECT record_id, unnest(string_split(post, chr(10))) AS x, generate_subscripts(string_split(post, chr(10)), 1) AS i FROM {POSTS}), f AS (SELECT *, trim(x) LIKE '%:' AND length(trim(x)) BETWEEN 4 AND 79 AS head FROM l),
    g AS (SELECT *, sum(head::INT) OVER (PARTITION BY record_id ORDER BY i) AS k FROM f), s AS (SELECT record_id, k, coalesce(max(regexp_replace(lower(trim(x)), ':$', '')) FILTER (head), '') AS header, trim(coalesce(string_agg(trim(x), chr(10) ORDER BY i) FILTER (NOT head), '')) AS body FROM g GROUP BY record_id, k)
    SELECT record_id, k::BIGINT AS k, header, length(body) AS n, md5(body) AS h FROM s UNION ALL SELECT record_id, 0::BIGINT, '', 0, md5('') FROM rec WHERE record_id NOT IN (SELECT record_id FROM s WHERE k = 0)""")
def _(v):
    return posts(v).select("record_id", F.posexplode(T.sections(F.col("post"))).alias("k", "s")).select("record_id", F.col("k").cast("bigint").alias("k"), "s.header", F.length("s.body").alias("n"), F.md5("s.body").alias("h"))


# --- de-duplication -------------------------------------------------------------

@query("shingle_counts", "SELECT record_id, count(DISTINCT g)::BIGINT AS n FROM (SELECT record_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS g FROM rec) GROUP BY ALL")
def _(v):
    return D.shingles(v.records.select("record_id", "text"), F.col("text")).groupBy("record_id").agg(F.count("*").alias("n"))


# 128 hashes of every text: too slow in SQL; tests hold a brute-force version.
query("minhash_signature", None)(lambda v: D.signatures(v.records.select("record_id", "text"), D.normalised(F.col("text"))))
query("dedup_chain", None)(lambda v: D.deduplicated(v.records.select("record_id", "text", F.concat("source", F.lit(":"), "record_id").alias("key")), F.col("key"), F.col("text"), ["record_id"]).select("record_id"))
query("usable_programmes", "SELECT record_id FROM (SELECT *, CASE WHEN record_id % 7 = 0 THEN '' ELSE text END AS t FROM rec) WHERE t <> '' AND NOT (source = 'src3' AND lang = 'fr')")(
    lambda v: D.usable_programmes(v.records.select("record_id", F.col("source").alias("name"), F.col("lang").alias("institution"), F.when(F.col("record_id") % 7 != 0, F.col("text")).alias("cleaned_text")), EXCLUDED).select("record_id")
)
query("usable_jobs", "SELECT record_id FROM rec WHERE record_id % 7 <> 0 AND lang IN ('en', 'es')")(
    lambda v: D.usable_jobs(v.records.select("record_id", F.when(F.col("record_id") % 7 != 0, F.col("text")).alias("cleaned_text"), F.col("lang").isin("en", "es").alias("language_supported"))).select("record_id")
)
query("programme_key_dedup", "SELECT min(p_partkey) AS p_partkey, lower(p_name) || '|' || lower(p_brand) AS k FROM part GROUP BY k")(
    lambda v: D.first_of(v.table("part").withColumn("k", D.identity_key(F.lit(None).cast("string"), F.col("p_name"), F.col("p_brand"))), F.col("k"), ["p_partkey"]).select("p_partkey", "k")
)
query("job_key_dedup", "SELECT page_id, k FROM (SELECT page_id, lower(CASE WHEN page_id % 3 = 0 THEN 'title ' || page_id % 10 ELSE url END) AS k FROM pages) QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) = 1")(
    lambda v: D.first_of(v.table("pages").withColumn("k", D.identity_key(F.when(F.col("page_id") % 3 != 0, F.col("url")), F.concat(F.lit("title "), (F.col("page_id") % 10).cast("string")))), F.col("k"), ["page_id"]).select("page_id", "k")
)


@query("merged_sources", "SELECT c_custkey, c_mktsegment, src FROM (SELECT c_custkey, c_mktsegment, 0 AS src FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer) WHERE NOT contains(lower(c_mktsegment), 'build') QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY src) = 1")
def _(v):
    c = v.table("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows = D.merged_sources([c.where("c_acctbal > 0").withColumn("src", F.lit(0)), c.withColumn("src", F.lit(1))], "c_mktsegment", ["build"], F.col("c_custkey"), ["src"])
    return rows.select("c_custkey", "c_mktsegment", F.col("src").cast("int"))


# --- sources --------------------------------------------------------------------

_TERMS = ["the", "and", "c\\+\\+", "of", "python", "docker", "sql", "java"]
query("skill_tags", f"SELECT record_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(post, {quoted('(?i)' + chr(92) + 'b(' + '|'.join(_TERMS) + ')' + chr(92) + 'b')}, 1), lambda x: lower(x)))), ',') AS tags FROM {POSTS}")(lambda v: posts(v).select("record_id", F.array_join(T.skill_tags(F.col("post"), _TERMS), ",").alias("tags")))
_DAY = "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE 'yesterday' END"
query("posting_age", "SELECT o_orderkey, o_orderkey % 3 <> 2 AND date_trunc('day', o_orderdate) < TIMESTAMP '1996-01-01' AS too_old FROM orders")(
    lambda v: v.table("orders").select("o_orderkey", T.posting_too_old(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.lit("yesterday")), F.lit("1996-01-01").cast("timestamp")).alias("too_old"))
)
query("target_options", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'land') OR contains(lower(n_name), 'ia') OR NOT EXISTS (SELECT 1 FROM nation WHERE contains(lower(n_name), 'land') OR contains(lower(n_name), 'ia'))")(lambda v: S.match_targets(v.table("nation"), "n_name", TARGETS).select("n_nationkey", "n_name"))
query("enriched", "SELECT record_id, md5(coalesce(CASE WHEN page_id % 2 = 0 THEN html END, text)) AS h FROM rec LEFT JOIN pages ON page_id = record_id")(
    lambda v: S.enrich(v.records.select("record_id", F.col("record_id").alias("url"), F.col("text").alias("extended_description")), v.table("pages").where("page_id % 2 = 0").select(F.col("page_id").alias("url"), F.col("html").alias("extended_description"))).select("record_id", F.md5("extended_description").alias("h"))
)


@query("taxonomy_parse", "SELECT row_number() OVER (ORDER BY p_partkey) AS n, 'u' || p_partkey AS uri, p_name AS preferred_label, array_to_string(list_filter(['alt one', p_name, p_brand], lambda x: x <> p_name), '|') AS alts, p_type AS description FROM part WHERE p_partkey % 5 <> 0")
def _(v):
    from pyspark.sql import Window

    raw = v.table("part").select(F.concat(F.lit("u"), "p_partkey").alias("﻿conceptUri"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("preferredLabel"), F.concat(F.lit("alt one\n"), "p_name", F.lit("\\n"), "p_brand").alias("altLabels"), F.lit("skill").alias("skillType"), F.lit("x").alias("reuseLevel"), F.lit(" ").alias("description"), F.col("p_type").alias("definition"), "p_partkey")
    rows = S.parse_taxonomy(raw)
    key = F.substring("uri", 2, 20).cast("long")
    return rows.select(F.row_number().over(Window.orderBy(key)).alias("n"), "uri", "preferred_label", F.array_join("alt_labels", "|").alias("alts"), "description")


query("label_index", "SELECT label_lc, uri FROM (SELECT lower(unnest([p_name, p_brand])) AS label_lc, unnest([0, 1]) AS place, 'u' || p_partkey AS uri, p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY label_lc ORDER BY p_partkey, place) = 1")(
    lambda v: K.label_index(v.table("part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("u"), "p_partkey").alias("uri"), F.col("p_name").alias("preferred_label"), F.array("p_brand").alias("alt_labels")))
)
query("json_summary", "SELECT source_type, '{\"n\":' || count(*) || ',\"longest\":' || max(length(text)) || ',\"first\":\"' || min(lang) || '\"}' AS summary FROM rec GROUP BY source_type")(
    lambda v: v.records.groupBy("source_type").agg(F.to_json(F.struct(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.min("lang").alias("first"))).alias("summary"))
)

# --- extraction -----------------------------------------------------------------

# Labels of one to three words: pairs and triples that are frequent, with skills.
_W = "regexp_extract_all(lower(text), '[a-z]+')"


@query("explicit_phrases", f"""WITH w AS (SELECT record_id, {_W} AS w FROM rec), g AS (SELECT record_id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS label FROM w), d AS (SELECT label, 'g:' || label AS uri FROM (SELECT label, count(DISTINCT record_id) AS n FROM g GROUP BY label) WHERE n BETWEEN 10 AND 40)
    SELECT record_id, uri, count(*) AS hits FROM g JOIN d USING (label) GROUP BY ALL""")
def _(v):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    # a gram counts once a text, where the text is read
    grams = v.bodies.select(words.alias("w")).select(F.explode(F.array_distinct(K.ngrams(F.col("w"), 2))).alias("label_lc"))
    often = grams.groupBy("label_lc").agg(F.count("*").alias("n")).where(F.col("n").between(10, 40))
    return K.dictionary_matches(v.records, kept(often.select("label_lc", F.concat(F.lit("g:"), "label_lc").alias("uri"))), words, longest=8)


@query("explicit_skills", """SELECT record_id, uri, matched_text, round(relevance, 4) AS confidence FROM (SELECT record_id, uri, preferred_label AS matched_text, (0.5 + CASE WHEN explicit THEN 20.0 ELSE 0.0 END + 2.0 * confidence)::DOUBLE / 24 AS relevance FROM skills
    UNION ALL SELECT record_id, uri, upper(preferred_label), (0.5 + 20.0 + 2.0 * confidence)::DOUBLE / 24 FROM skills WHERE tf >= 3) WHERE relevance >= 0.35 QUALIFY row_number() OVER (PARTITION BY record_id, uri ORDER BY relevance DESC, matched_text) = 1""")
def _(v):
    s, hit = v.skills, F.col("explicit").cast("double")
    score = lambda d: K.relevance(F.lit(0.5), F.lit(0.0), d, F.col("confidence"))
    a = s.select("record_id", F.col("preferred_label").alias("surface"), F.when(F.col("explicit"), F.col("uri")).alias("dictionary_uri"), F.col("uri").alias("nearest_uri"), score(hit).alias("relevance"))
    b = s.where("tf >= 3").select("record_id", F.upper("preferred_label").alias("surface"), F.col("uri").alias("dictionary_uri"), F.lit(None).cast("string").alias("nearest_uri"), score(F.lit(1.0)).alias("relevance"))
    return K.best_surfaces(a.unionByName(b))


#: The test vectors are far apart; at the usual 0.6 none has a neighbour.
NEAR = 0.3


def _neighbours(v, of):
    # the 11 first of all vectors hold a record's 10 first others, whether or not it is among them
    have = v.vectors.join(v.records.select("record_id"), "record_id", "left_semi").select("record_id", "embedding")
    near = A.vector_blocks(of(have), have, top=11, by="dot")
    return near.select(F.col("programme_id").alias("record_id"), F.col("job_id").alias("other_id"), F.col("dot").alias("cosine"))


_IMPLICIT = """SELECT n.record_id, s.uri, round(max(n.cosine), 4) AS confidence FROM (SELECT * FROM (SELECT a.record_id, b.record_id AS other_id, round(list_inner_product(a.embedding, b.embedding), 9) AS cosine FROM vec a JOIN rec USING (record_id), vec b JOIN rec r2 USING (record_id) WHERE a.record_id <> b.record_id{only})
    WHERE cosine >= 0.3 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY cosine DESC, other_id) <= 10) n JOIN skills s ON s.record_id = n.other_id AND s.explicit
    WHERE NOT EXISTS (SELECT 1 FROM skills m WHERE m.record_id = n.record_id AND m.uri = s.uri AND m.explicit) GROUP BY ALL"""
query("implicit_propagation", _IMPLICIT.format(only=""))(lambda v: K.implicit_skills(_neighbours(v, lambda d: d), v.skills, threshold=NEAR))
# an auxiliary corpus (odd ids) joins the pool of neighbours and never the output
query("implicit_auxiliary", _IMPLICIT.format(only=" AND a.record_id % 2 = 0"))(lambda v: K.implicit_skills(_neighbours(v, lambda d: d.where("record_id % 2 = 0")), v.skills, threshold=NEAR))
