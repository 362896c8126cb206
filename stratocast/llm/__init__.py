"""Operators for preparing language-model training data.

Nothing else in the library imports this package; ``catalog`` lists its
queries and ``corpus_pipeline.py`` (repository top) chains five of them.
"""
