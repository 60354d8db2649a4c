"""Operators for building training data from large document tables.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
