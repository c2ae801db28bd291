"""Operators for large-scale training-data preparation.

The subpackage stands alone: nothing else in the library imports it.
"""
