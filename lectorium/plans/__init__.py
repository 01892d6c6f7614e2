"""Registered queries, by area. Importing this package fills the registry."""

import importlib

AREAS = ["matching", "ledger", "listings", "retrieval", "cleanup", "editing", "transfer", "streams"]
for _area in AREAS:
    importlib.import_module(f"{__name__}.{_area}")
