"""All queries over the driver's tables, and their SQL."""

from tessitura.plans import array_queries, point_queries, signal_queries, sound_queries

QUERIES = {**signal_queries.QUERIES, **point_queries.QUERIES, **array_queries.QUERIES, **sound_queries.QUERIES}
ORACLES = {**signal_queries.ORACLES, **point_queries.ORACLES, **array_queries.ORACLES, **sound_queries.ORACLES}
