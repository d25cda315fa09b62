"""Operators for training-data pipelines (texts, conversations, fingerprints).

Self-contained: nothing else in the library imports this package. Each module
holds one operator with its own general interface; ``queries`` holds the thin
registered queries.
"""
