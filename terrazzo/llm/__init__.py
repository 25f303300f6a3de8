"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; ``queries`` registers its
operators for ``__spark_entry__``.
"""
