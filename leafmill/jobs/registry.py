"""Queries over the given tables, with the SQL that checks them."""

from __future__ import annotations

from leafmill.jobs import conversions, formulas, markup, outlines, pages, projects, references, renders, scalars

FLAGSHIP = "w4_page_outline"
MODULES = [scalars, outlines, pages, references, projects, renders, markup, formulas, conversions]
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
