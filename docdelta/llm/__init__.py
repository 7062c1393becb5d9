"""Operators for preparing language-model training data, one module each.

Nothing outside this folder imports it; `registry` lists its queries.
"""
