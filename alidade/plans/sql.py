"""SQL of the base tables and of the queries, as DuckDB runs it.

A query names views below; ``compose`` puts those it needs, and theirs, in
front of it."""

from __future__ import annotations

import re

VIEWS = {
    "rec": "SELECT doc_id AS record_id, CASE WHEN source = 'src0' THEN 'programme' ELSE 'job_ad' END AS source_type, text, lang, source FROM documents",
    "terms": "SELECT record_id, word, count(*) AS tf FROM (SELECT record_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM rec) GROUP BY ALL",
    "tax": """SELECT 'esco:' || word AS uri, word AS preferred_label, CASE length(word) % 4 WHEN 0 THEN 'transversal' WHEN 1 THEN 'cross-sector' WHEN 2 THEN 'sector-specific' ELSE 'occupation-specific' END AS reuse_level
        FROM (SELECT word, count(*) AS df FROM terms GROUP BY word) WHERE length(word) >= 6 AND df BETWEEN 5 AND 200""",
    "skills": """SELECT record_id, uri, preferred_label, tf, (tf >= 2 OR (record_id + length(word)) % 2 = 0) AS explicit,
        CASE WHEN tf >= 2 OR (record_id + length(word)) % 2 = 0 THEN 1.0::DOUBLE ELSE (length(word) % 5)::DOUBLE / 10 + 0.5::DOUBLE END AS confidence FROM terms JOIN tax ON word = preferred_label""",
    "vec": "SELECT vec_id AS record_id, embedding::DOUBLE[] AS embedding, label AS cluster_label FROM embeddings",
    "clu": "SELECT record_id, source_type, coalesce(cluster_label, -1) AS cluster_label FROM rec LEFT JOIN vec USING (record_id)",
    "np": "SELECT count(*) FILTER (source_type = 'programme') AS n_programmes FROM rec",
    "idf": "SELECT uri, df, ln(1 + n::DOUBLE / df) AS idf FROM (SELECT uri, count(DISTINCT record_id) AS df FROM skills GROUP BY uri), (SELECT count(*) AS n FROM rec)",
    "pidf": "SELECT uri, df, ln(1 + n::DOUBLE / df) AS idf FROM (SELECT uri, count(DISTINCT record_id) AS df FROM skills JOIN rec USING (record_id) WHERE source_type = 'programme' GROUP BY uri), (SELECT n_programmes AS n FROM np)",
    "w_uni": "SELECT record_id, uri, max(CASE WHEN explicit THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM skills GROUP BY ALL",
    "w_idf": "SELECT record_id, uri, max(least(coalesce(idf, 1.0), 3.0) * CASE WHEN explicit THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM skills LEFT JOIN idf USING (uri) GROUP BY ALL",
    "w_pidf": "SELECT record_id, uri, max(least(coalesce(idf, 1.0), 3.0) * CASE WHEN explicit THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM skills LEFT JOIN pidf USING (uri) GROUP BY ALL",
    "pairs": "SELECT p.record_id AS programme_id, j.record_id AS job_id FROM rec p, rec j WHERE p.source_type = 'programme' AND j.source_type = 'job_ad'",
    "sem": """SELECT p.record_id AS programme_id, j.record_id AS job_id, round(list_inner_product(a.embedding, b.embedding) / sqrt(list_inner_product(a.embedding, a.embedding)) / sqrt(list_inner_product(b.embedding, b.embedding)), 9) AS cosine,
        round(list_inner_product(a.embedding, b.embedding), 9) AS dot
        FROM rec p JOIN vec a USING (record_id), rec j JOIN vec b USING (record_id) WHERE p.source_type = 'programme' AND j.source_type = 'job_ad'""",
    "gaps": """SELECT programme_id, job_id, j.uri AS gap_uri, round(j.w - coalesce(p.w, 0), 4) AS gap_weight
        FROM (SELECT * FROM sym QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY weighted_jaccard DESC, job_id) <= 20) t
        JOIN w_uni j ON j.record_id = job_id LEFT JOIN w_uni p ON p.record_id = programme_id AND p.uri = j.uri WHERE j.w > coalesce(p.w, 0)""",
    "top50": "SELECT programme_id, job_id, cosine FROM sem QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY cosine DESC, job_id) <= 50",
    "quality": """SELECT t.programme_id, t.job_id, CASE WHEN own_idf IS NULL THEN 1.0 ELSE least(2.0, greatest(0.5, CASE WHEN job_idf > 0 THEN own_idf / job_idf ELSE 1.0 END)) * (1 - 0.3 * generic) END AS quality
        FROM top50 t LEFT JOIN (SELECT record_id AS job_id, avg(idf) AS job_idf FROM skills JOIN idf USING (uri) GROUP BY ALL) USING (job_id)
        LEFT JOIN (SELECT programme_id, job_id, avg(idf) AS own_idf, avg(CASE WHEN idf < (SELECT median(idf) FROM idf) THEN 1.0 ELSE 0.0 END) AS generic
            FROM top50 JOIN skills j ON j.record_id = job_id JOIN skills p ON p.record_id = programme_id AND p.uri = j.uri JOIN idf i ON i.uri = j.uri GROUP BY ALL) USING (programme_id, job_id)""",
    "recall": """SELECT t.programme_id, t.job_id, t.cosine, round(coalesce(shared, 0) / coalesce(nullif(sb, 0), 1) * quality, 9) AS recall FROM top50 t JOIN quality USING (programme_id, job_id)
        LEFT JOIN (SELECT programme_id, job_id, sum(least(p.w, j.w)) AS shared FROM top50 JOIN w_pidf p ON p.record_id = programme_id JOIN w_idf j ON j.record_id = job_id AND j.uri = p.uri GROUP BY ALL) USING (programme_id, job_id)
        LEFT JOIN (SELECT record_id AS job_id, sum(w) AS sb FROM w_idf GROUP BY ALL) USING (job_id)""",
    "ranges": "SELECT programme_id, max(cosine) - min(cosine) AS span FROM top50 GROUP BY ALL",
    "normed": """SELECT r.programme_id, job_id, cosine, recall, coalesce((cosine - min(cosine) OVER p) / nullif(max(cosine) OVER p - min(cosine) OVER p, 0), 0) AS c0,
        CASE WHEN m > 0 THEN least(1.0, span / m) ELSE 1.0 END AS confidence, coalesce((recall - min(recall) OVER p) / nullif(max(recall) OVER p - min(recall) OVER p, 0), 0) AS r
        FROM recall r JOIN ranges USING (programme_id), (SELECT median(span) AS m FROM ranges) WINDOW p AS (PARTITION BY r.programme_id)""",
    "mixed": "SELECT *, round(0.55::DOUBLE * c0 * confidence + 0.45::DOUBLE * r, 9) AS mixed FROM normed",
    "often": """SELECT job_id, count(DISTINCT programme_id) AS often FROM (SELECT * FROM mixed QUALIFY row_number() OVER (PARTITION BY programme_id ORDER BY mixed DESC, cosine DESC, job_id) <= 30) GROUP BY ALL""",
    "ipf": "SELECT m.*, n_programmes, coalesce(often, 1) AS n_often, ln(1 + n_programmes::DOUBLE / coalesce(often, 1)) AS ipf FROM mixed m LEFT JOIN often USING (job_id), np",
    "penal": """SELECT *, coalesce(f + (1 - f) * (ipf - lo) / nullif(hi - lo, 0), 1.0) AS penalty FROM (SELECT *, CASE WHEN n_often >= greatest(2, floor(n_programmes * 0.5)) THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS f,
        min(ipf) OVER () AS lo, max(ipf) OVER () AS hi FROM ipf)""",
    "hyb": "SELECT programme_id, job_id, cosine AS cosine_score, recall AS recall_score, round(mixed * penalty, 9) AS hybrid_score FROM penal",
    "cand": """SELECT t.programme_id, t.job_id, t.cosine, round(CASE WHEN coalesce(pa, 0) + coalesce(jb, 0) - coalesce(m, 0) > 0 THEN coalesce(m, 0) / (coalesce(pa, 0) + coalesce(jb, 0) - coalesce(m, 0)) ELSE 0 END, 9) AS wj FROM top50 t
        LEFT JOIN (SELECT programme_id, job_id, sum(least(p.w, j.w)) AS m FROM top50 JOIN w_uni p ON p.record_id = programme_id JOIN w_uni j ON j.record_id = job_id AND j.uri = p.uri GROUP BY ALL) USING (programme_id, job_id)
        LEFT JOIN (SELECT record_id AS programme_id, sum(w) AS pa FROM w_uni GROUP BY ALL) USING (programme_id) LEFT JOIN (SELECT record_id AS job_id, sum(w) AS jb FROM w_uni GROUP BY ALL) USING (job_id)""",
}


def _sym(p: str, j: str) -> str:
    return f"""SELECT programme_id, job_id, round(CASE WHEN a + b - m > 0 THEN m / (a + b - m) ELSE 0 END, 9) AS weighted_jaccard, round(CASE WHEN least(a, b) > 0 THEN m / least(a, b) ELSE 0 END, 9) AS overlap_coeff,
        round(CASE WHEN b > 0 THEN m / b ELSE 0 END, 9) AS programme_recall FROM (SELECT programme_id, job_id, coalesce(m, 0.0::DOUBLE) AS m, coalesce(a, 0.0::DOUBLE) AS a, coalesce(b, 0.0::DOUBLE) AS b FROM pairs
        LEFT JOIN (SELECT p.record_id AS programme_id, j.record_id AS job_id, sum(least(p.w, j.w)) AS m FROM {p} p JOIN rec rp ON rp.record_id = p.record_id AND rp.source_type = 'programme' JOIN {j} j ON j.uri = p.uri JOIN rec rj ON rj.record_id = j.record_id AND rj.source_type = 'job_ad' GROUP BY ALL) USING (programme_id, job_id)
        LEFT JOIN (SELECT record_id AS programme_id, sum(w) AS a FROM {p} GROUP BY ALL) USING (programme_id) LEFT JOIN (SELECT record_id AS job_id, sum(w) AS b FROM {j} GROUP BY ALL) USING (job_id))"""


VIEWS |= {"sym": _sym("w_uni", "w_uni"), "sym_idf": _sym("w_idf", "w_idf"), "sym_pidf": _sym("w_pidf", "w_idf")}


def compose(query: str) -> str:
    """The query behind the views that it names, in order of need."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if name in VIEWS and name not in order and VIEWS[name] is not text:
                need(VIEWS[name])
                if name not in order:
                    order.append(name)

    need(query)
    views = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    if not views:
        return query
    return f"WITH {views}, {query[5:]}" if query.startswith("WITH ") else f"WITH {views} {query}"
