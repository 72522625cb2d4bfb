"""Operators for large-scale training-data preparation.

Nothing outside this package imports it; it can be deleted as a whole.
"""
