"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from .plans import fleets, judging, lands, matching, rollups, space, texts, timelines
from .plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "fleets", "judging", "lands", "matching", "rollups", "space", "texts", "timelines"]
