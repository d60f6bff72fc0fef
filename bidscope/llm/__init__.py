"""Training-data operators: tokenisation, deduplication, quality, licences, packing, fingerprints.

Each module holds one operator with a general interface over DataFrames; ``queries`` holds the named queries
over the test tables. Nothing outside this package imports it.
"""
