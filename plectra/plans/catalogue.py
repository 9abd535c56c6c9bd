"""Every query of the sequence engine and its SQL."""

from __future__ import annotations

from .families import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
