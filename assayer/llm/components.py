"""Connected components of a table of links: the library's own."""

from __future__ import annotations

from assayer.operators.components import components

__all__ = ["components"]
