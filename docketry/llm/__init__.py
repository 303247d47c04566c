"""Operators for large training-data pipelines: fingerprints, near and suffix dedup, packing,
filters, language ID, sanitisation, tokenisation and vector search.

Nothing outside this subpackage imports it. ``queries.py`` registers one query per operator.
"""
