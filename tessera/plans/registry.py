"""Queries of the engine's own operators, by name, and their SQL."""

from __future__ import annotations

from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
