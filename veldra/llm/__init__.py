"""Operators for large-scale training data. Nothing outside this subpackage imports it, except the entry module."""
