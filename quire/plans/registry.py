"""Every query of the engine with its SQL twin."""

from __future__ import annotations

from quire.plans import catalog, facets, house, retrieval, sections, structure, tally, text, verification

FLAGSHIP = "survey_windowed"
QUERIES: dict = {}
SQL: dict = {}
for _module in (tally, facets, retrieval, text, structure, sections, catalog, house, verification):
    QUERIES |= _module.query.queries
    SQL |= _module.query.sql
