"""Operators that prepare text corpora for training large models.

Nothing outside this subpackage imports it.
"""
