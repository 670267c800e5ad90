"""Registered queries over the driver's tables, their SQL, and the map's questions."""

from .api import CodeMap, UsageError
from .oracles import ORACLE_SQL
from .queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "CodeMap", "UsageError"]
