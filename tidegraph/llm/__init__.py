"""Operators of a training-data pipeline: text, pages, conversations and vectors.

Nothing outside this package imports it; see ``queries.py`` for the registered queries.
"""
