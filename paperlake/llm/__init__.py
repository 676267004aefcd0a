"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it.  Each module is one operator with a general
interface; ``queries.py`` holds the thin registered queries over the standard tables.
"""
