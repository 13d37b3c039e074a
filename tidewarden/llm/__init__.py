"""Operators for building language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Each operator is a function from
DataFrames to a DataFrame; ``queries`` applies each with production parameters.
"""
