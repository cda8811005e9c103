"""Operators for preparing training data at scale: filters, tokenizers, deduplication, packing.

Each module has one operator with its own interface; ``queries`` has the thin ``opN_<name>``
queries over them.  Nothing outside this folder imports it.
"""
