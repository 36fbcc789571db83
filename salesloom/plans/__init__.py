"""Registered queries, each beside the SQL that must give the same rows."""

from importlib import import_module

MODULES = ("ingest", "filters", "joins", "metrics", "business", "finance", "values", "documents", "retrieval", "audits", "streams")


def load_all():
    """Import every plan module once; the register and its check SQL."""
    for module in MODULES:
        import_module(f"salesloom.plans.{module}")
    from salesloom.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
