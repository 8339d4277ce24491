"""Registered queries, grouped by subject. ``load()`` imports every group once."""

from importlib import import_module

GROUPS = ["text", "chunks", "search", "fusion", "analytics", "ingest", "evaluation", "streams", "hybrid", "sources"]


def load():
    for group in GROUPS:
        import_module(f"docketlake.plans.{group}")
    return import_module("docketlake.plans.registry")
