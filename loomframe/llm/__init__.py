"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it; `registry.py` holds the queries that the driver contract registers.
"""
