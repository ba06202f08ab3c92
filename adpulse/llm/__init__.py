"""Operators for building language-model training data.

Each module holds one operator with its own general interface;
``queries.py`` registers the thin ``opN_`` queries over the given tables.
Nothing else in the library imports this package.
"""
