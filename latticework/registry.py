"""All queries of the library, with the SQL that checks them."""

from __future__ import annotations

from .queries import anchored, graph, metrics, motif, neighbours, spatial, tables, templates

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (motif, spatial, neighbours, graph, metrics, tables, anchored, templates):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
