"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface; ``queries`` has the thin registered queries and their
SQL.
"""
