"""Operators for building training corpora: deduplication, filtering, mixing, sharding.

Each module holds one operator with a general interface; :mod:`pricewright.llm.queries`
binds them to the synthetic tables.  Nothing outside this subpackage imports it.
"""
