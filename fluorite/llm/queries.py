"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, jaccard, licenses, lines, mixing, neighbours, personal, quality, tokens, toxicity

MODULES = (tokens, toxicity, personal, quality, mixing, jaccard, licenses, neighbours, decontamination, lines)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
