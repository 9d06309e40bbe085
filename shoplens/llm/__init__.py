"""Operators of a training-data pipeline over a ``documents`` table.

Self-contained: the rest of the library never imports this package. Each
operator lives in its own module with a general interface; ``queries``
registers one query per operator with its production parameters.
"""
