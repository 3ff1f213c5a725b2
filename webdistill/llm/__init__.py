"""Operators for building training data at corpus scale.

Nothing outside this subpackage imports it.  Every operator module has a general interface of its own;
``entry.py`` holds the thin ``opN_*`` queries that derive the digest columns, and their SQL.
"""
