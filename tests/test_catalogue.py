import pytest
from compare import connect, differ

from alidade.plans import catalogue

AT = "/root/testdata/sf0.001"
CHECKED = ["symbolic_uniform_rank", "skill_gaps_uniform", "corpus_idf", "semantic_cosine", "bm25_rank", "spearman_pairs", "programme_coverage", "alpha_sweep", "fingerprint_dedup", "market_trends", "top_skills", "implicit_propagation", "record_processor", "section_parse", "explicit_phrases", "alpha_rebalance", "formula_grid"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    df = catalogue.QUERIES[name](spark, AT)
    assert not df.isEmpty()  # no rows on both sides would prove nothing
    assert differ(catalogue.QUERIES[name](spark, AT), connect(AT), catalogue.SQL[name]) == ""


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
