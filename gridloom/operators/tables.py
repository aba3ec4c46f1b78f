"""Where loops cut their lineage."""

from __future__ import annotations

from gridloom.shared import materialize as cut
from gridloom.shared import release, tidy

__all__ = ["cut", "release", "tidy"]
