"""Operators for preparing training text: deduplication, language, quality, mixing, scoring, formatting, search, tokens.

Nothing outside this folder imports it; the registered queries are in ``queries``.
"""
