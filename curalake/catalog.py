"""The library's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from curalake.plans import articles, corrections, documents, first_seen, grammars, parsing, records, relations, reports, rollups, screens, selection, sessions, streams, trials, updates, wording  # noqa: F401  (they register their queries)
from curalake.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = selection.table_page

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
