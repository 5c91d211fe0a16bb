"""All registered queries."""

from __future__ import annotations

from . import faceted, operations, parsed, reached, recorded, relational, retrieval, stored, textual, viewed  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
