"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from checks.registry import oracles, registered

from checks import (  # noqa: F401  (registration by import)
    axes,
    chunking,
    coverage,
    joins,
    paths,
    reports,
    runs,
    texts,
    verdicts,
)

__all__ = ["oracles", "registered"]
