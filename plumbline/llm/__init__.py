"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries`` has the thin registered
queries and their SQL.
"""
