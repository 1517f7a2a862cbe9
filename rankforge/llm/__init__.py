"""Operators for building language-model training data.

Nothing outside this subpackage imports it.  Every module states its own
treatment of nulls, empty and long texts, ties, repeated rows and empty tables.
"""
