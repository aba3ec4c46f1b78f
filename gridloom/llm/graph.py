"""Connected components by alternating large-star and small-star, all edges in tables."""

from __future__ import annotations

from gridloom.operators.graph import components

__all__ = ["components"]
