"""Every registered query by name, and its SQL."""

from __future__ import annotations

from seqloom.plans import designs, mining, others, similar, strings
from seqloom.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "designs", "mining", "others", "similar", "strings"]
