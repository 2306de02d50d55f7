"""Operators for training-data pipelines over text tables.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; ``queries`` registers one thin query per
operator over the test tables.
"""
