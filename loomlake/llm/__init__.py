"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; the entry module adds its queries
only when it can be imported.
"""
