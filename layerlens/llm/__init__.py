"""Operators for preparing large text corpora as training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns DataFrames; ``queries`` holds the registered queries.
"""
