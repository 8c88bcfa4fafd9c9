"""Operators of large-scale training-data preparation."""
