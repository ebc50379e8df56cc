"""Operators for preparing training data: dedup, classifiers, mixing, tokens.

Nothing outside this subpackage imports it.
"""
