"""Corpus-preparation operators for training data.

Nothing else in the library imports this subpackage.  Each operator is a
function from DataFrames to DataFrames; :mod:`lumengraph.llm.queries` holds the
thin registered queries and their SQL oracles.
"""
