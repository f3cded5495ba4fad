"""Operators of a training-data pipeline over a table of documents.

Nothing outside this package imports it. `queries` registers one query an operator.
"""
