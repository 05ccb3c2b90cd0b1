"""Registered queries over the driver's tables, with their SQL equivalents."""

from __future__ import annotations

from lorefold.plans import documents, registry, retrieval, sessions, stored

QUERIES = {**documents.QUERIES, **retrieval.QUERIES, **registry.QUERIES, **sessions.QUERIES, **stored.QUERIES}
ORACLES = {**documents.ORACLES, **retrieval.ORACLES, **registry.ORACLES, **sessions.ORACLES, **stored.ORACLES}

