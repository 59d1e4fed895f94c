"""All registered queries of the reference's operators, with their SQL."""

from __future__ import annotations

from streetweave.plans import core, files, places, rasters, records, scenes  # noqa: F401
from streetweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
