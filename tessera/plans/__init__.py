"""Queries over the driver tables, with the SQL that gives the same rows."""

from tessera.plans import knowledge, lifecycle, search, service, usage

CATALOG = search.CATALOG | knowledge.CATALOG | usage.CATALOG | service.CATALOG | lifecycle.CATALOG
QUERIES = {name: query for name, (query, _) in CATALOG.items()}
SQL = {name: sql for name, (_, sql) in CATALOG.items() if sql}
