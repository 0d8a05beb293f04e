"""Operators for large-scale text and vector collections.

Nothing outside this subpackage imports it.
"""
