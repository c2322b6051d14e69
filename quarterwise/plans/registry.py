"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from quarterwise.plans import chats, ingest, models, panel, scoring

_MODULES = (panel, scoring, ingest, chats, models)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: text for m in _MODULES for name, text in m.ORACLE.items()}
