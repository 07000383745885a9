"""Operators for training-data pipelines (mixing, dedup, packing, language id, extraction, ...).

Nothing else in the library imports this subpackage. ``queries.py`` holds the registered
queries and their SQL; every other module is one operator with a general interface.
"""
