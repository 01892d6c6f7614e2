"""Lecture analytics on Spark: timed text, search, matching, packing, ledgers and table upkeep as DataFrame operators."""
