"""Every registered query of the library, with its SQL."""

from __future__ import annotations

from . import books, catalog, files, more, queues, reports, roles, shapes

FLAGSHIP = "match_best"
MODULES = (catalog, reports, more, books, files, queues, roles, shapes)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
