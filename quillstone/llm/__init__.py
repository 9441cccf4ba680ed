"""Training-data operators: language ID, dedup, toxicity, packing, URL rules,
near-dedup, tokenisation, binary token files, vector search and PII.

Nothing outside this package imports it.
"""
