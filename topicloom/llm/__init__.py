"""Operators for preparing language-model training data.

Every operator is a function on DataFrames with the names of its input columns
as parameters.  Inputs may hold columns of any other name: operators select
what they need, or carry a whole row in one struct, so names never clash.
"""
