"""Operators for building text corpora for language models.

Nothing else in the library imports this subpackage; the registry of its
queries is :mod:`scrubjay.llm.queries`.
"""
