"""Training-data operators: dedup, packing, classification, extraction, media.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries.py`` has the registered queries.
"""
