"""Scalar functions of the query language as columns."""
