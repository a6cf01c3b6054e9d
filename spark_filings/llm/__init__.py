"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface and the thin query that applies it to
the whole of its table.
"""
