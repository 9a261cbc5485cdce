"""Training-data operators: extraction, tokenising, quality, secrets, near duplicates, packing.

Nothing else in the library imports this package. Each operator is a module with a general
interface; ``queries.py`` holds the thin registered queries.
"""
