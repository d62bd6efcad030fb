"""Operators for preparing training data: dedup, filtering, tokenising, scanning.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; ``queries.py`` holds the thin queries that apply them to the
synthetic tables.
"""
