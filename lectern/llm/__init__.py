"""Operators for building training corpora.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; the `opN_` queries in :mod:`lectern.llm.queries` are thin
projections of what the operators return.
"""
