"""Every query of the library by name, with its SQL where SQL can say it."""

from __future__ import annotations

from .plans import queries, stores, streams

QUERIES: dict = queries.QUERIES | streams.QUERIES | stores.QUERIES
ORACLES: dict[str, str] = queries.ORACLES | streams.ORACLES | stores.ORACLES
