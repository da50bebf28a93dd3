"""Operators that prepare text, page and vector tables for model training.

Nothing else in the library imports this subpackage.
"""
