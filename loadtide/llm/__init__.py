"""Operators for large text corpora: cleaning, near-duplicates, scoring, tokens, packing, search.

Every operator is a function from DataFrames to a DataFrame. Queries over the given tables are in
``queries``. Nothing outside this subpackage imports it.
"""
