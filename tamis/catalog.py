"""All queries of the selection engine and the SQL that gives the same results."""

from __future__ import annotations

from tamis.oracles import ORACLES
from tamis.queries import QUERIES, flagship

FLAGSHIP = flagship

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
