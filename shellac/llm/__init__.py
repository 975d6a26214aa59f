"""Operators for preparing training data: packing, formatting, filtering, near duplicates, search, mixing.

Each operator is a plain function over DataFrames with its own parameters and real outputs.
``queries.py`` holds the thin digest queries over the shared test tables.
"""
