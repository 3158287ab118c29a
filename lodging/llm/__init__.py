"""Operators for preparing training data at scale.

Each module holds one operator: a general interface over DataFrames plus the
thin ``opN_*`` query that applies it to a whole table.  Nothing outside this
subpackage imports it; the registry is ``lodging.llm.catalog``.
"""
