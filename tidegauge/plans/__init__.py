"""Registered queries over the driver tables."""

from importlib import import_module

MODULES = ("scalars", "ingest", "metrics", "observability", "detection", "evaluation", "inventory", "governance", "models", "evidence", "audits", "streams", "stores")


def load():
    from . import base
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return base.QUERIES, base.ORACLES
