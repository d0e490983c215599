"""Training-data operators: search, extraction, filtering, deduplication, mixing and packing.

Nothing outside this folder imports it; ``queries.py`` lists the queries it offers.
"""
