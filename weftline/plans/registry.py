"""Queries of the engine, by name, with their DuckDB equivalents."""

from weftline.plans.oracles import ORACLES
from weftline.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
