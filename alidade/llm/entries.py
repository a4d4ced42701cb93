"""The operators' queries, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from .decontamination import op3_decontamination
from .language_model import op6_masked_pseudo_likelihood
from .mixing import op5_pareto_mixing
from .pages import op8_wrapper_text
from .quality import op4_quality_rules
from .secrets import op1_markov_secrets
from .simhash import op7_simhash_bktree
from .tokens import op2_token_counts
from .toxicity import op9_toxicity
from .urls import op10_url_rules


def queries() -> dict:
    return {
        "op1_markov_secrets": op1_markov_secrets,
        "op2_token_counts": op2_token_counts,
        "op3_decontamination": op3_decontamination,
        "op4_quality_rules": op4_quality_rules,
        "op5_pareto_mixing": op5_pareto_mixing,
        "op6_masked_pseudo_likelihood": op6_masked_pseudo_likelihood,
        "op7_simhash_bktree": op7_simhash_bktree,
        "op8_wrapper_text": op8_wrapper_text,
        "op9_toxicity": op9_toxicity,
        "op10_url_rules": op10_url_rules,
    }


def oracle_sql() -> dict[str, str]:
    """None of the ten is expressible: models and token libraries stand behind
    their columns. tests/llm holds the brute-force versions."""
    return {}
