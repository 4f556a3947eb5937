"""Connected components for the corpus operators: those of the library."""

from __future__ import annotations

from ..operators.components import connected_components

__all__ = ["connected_components"]
