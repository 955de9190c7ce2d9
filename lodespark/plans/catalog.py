"""Every query by name, and the SQL that checks it where SQL can express it."""

from lodespark.plans import data_queries, io_queries, mining_queries, relational_queries, series_queries, stream_queries

_MODULES = (data_queries, relational_queries, io_queries, mining_queries, series_queries, stream_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
