"""Training-data operators: extraction, search, sharding, dedup, language ID, WARC, mixing.

Nothing else in the library imports this subpackage.
"""
