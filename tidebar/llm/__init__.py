"""Operators for large text corpora: near-duplicate search, tokenizing, scoring, sharding and mixing.

Each module holds one operator with a DataFrame-in, DataFrame-out interface.
``queries`` binds them to the standard tables. Nothing else in the library
imports this subpackage.
"""
