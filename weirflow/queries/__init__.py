"""Queries of the engine's own operators, each with its SQL counterpart."""

from weirflow.queries import routes, rows, tables

QUERIES = routes.QUERIES | rows.QUERIES | tables.QUERIES
ORACLES = routes.ORACLES | rows.ORACLES | tables.ORACLES
