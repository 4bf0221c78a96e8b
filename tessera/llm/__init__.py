"""Operators for large-scale training-data pipelines, one module per operator.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator.
"""
