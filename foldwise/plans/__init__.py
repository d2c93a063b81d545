"""Registered queries: each reads the given tables and has its SQL beside it where SQL can express it."""

from importlib import import_module
from pathlib import Path


def load():
    """All registered queries and their SQL."""
    for f in sorted(Path(__file__).parent.glob("*.py")):
        if f.stem not in ("__init__", "common"):
            import_module(f"foldwise.plans.{f.stem}")
    from foldwise.plans.common import ORACLES, QUERIES
    return QUERIES, ORACLES
