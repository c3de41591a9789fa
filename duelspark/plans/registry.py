"""All registered contest queries with their SQL counterparts."""

from __future__ import annotations

from . import contests, rows, scalars

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (contests, scalars, rows):
    QUERIES.update(_part.QUERIES)
    ORACLE.update(_part.ORACLE)
