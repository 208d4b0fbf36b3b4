"""Training-data operators: one module per operator, each with its query.

Nothing outside this subpackage imports it.  Operators take and return
DataFrames; the contract digests are derived in :mod:`barloom.llm.registry`.
"""
