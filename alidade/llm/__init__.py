"""Training-data operators: secrets, tokens, decontamination, quality, mixing,
language-model scores, near-duplicates, page text, toxicity and URL filters.

Nothing outside this folder imports it.
"""
