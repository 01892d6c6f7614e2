"""Training-data operators: cleaning, mixing, deduplication, tokenising, search and sharding of text corpora.

Self-contained: nothing else in the library imports this package, and it imports nothing from the rest.
"""
