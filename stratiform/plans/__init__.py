"""Registered queries, the fixture relations they read, and the layer jobs."""

from importlib import import_module

FAMILIES = (
    "gold_queries",
    "quality_queries",
    "silver_queries",
    "enrich_queries",
    "file_queries",
    "arrival_queries",
    "temporal_queries",
    "rollup_queries",
    "version_queries",
)


def all_queries():
    """The registry, with every query family loaded."""
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    return import_module(f"{__name__}.registry")
