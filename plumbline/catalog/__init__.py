"""Named queries over the given tables, one module per part of the engine."""

from importlib import import_module

from plumbline.catalog.registry import ORACLES, QUERIES

MODULES = (
    "audit",
    "gold",
    "profiling",
    "preparation",
    "evaluation",
    "defects",
    "experiments",
    "ingestion",
    "loads",
    "models",
)

for _name in MODULES:
    import_module(f"plumbline.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
