"""All queries of the page analytics engine and their DuckDB oracles, by name."""

from __future__ import annotations

from folio.operators import edit_log, frames, geometry, hyphenation, predicates, render, sequence, sessions, similarity, structure, titles, typography
from folio.sources import image_headers
from folio.streaming import replayed

QUERIES: dict = {}
SQL: dict = {}
for _module in (edit_log, frames, geometry, hyphenation, predicates, render, sequence, sessions, similarity, structure, titles, typography, image_headers, replayed):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
