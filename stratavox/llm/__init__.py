"""Training-data operators: scoring, decontamination, dedup, PII, tokenisation.

Nothing outside this subpackage imports it.
"""
