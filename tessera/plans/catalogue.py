"""All queries of the library by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import analytics, chat, corpus, files, pages, records, rules, specs, streams, training
from .registry import Query

_MODULES = (corpus, chat, pages, specs, rules, records, analytics, files, streams, training)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.registry.sql.items()}
