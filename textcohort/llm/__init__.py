"""Operators of a training-data pipeline: one module per operator, one registry of queries.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` / ``queries.ORACLE`` hold the
registered queries; ``corpus_pipeline.py`` at the repository top chains five of the operators.
"""
