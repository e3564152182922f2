"""All queries of the core library and, where SQL can say them, their SQL."""

from __future__ import annotations

from loomgraph.plans import graph_queries, problems, staging_queries  # noqa: F401  (registers its queries)

QUERIES = graph_queries.QUERIES | problems.QUERIES
ORACLE = graph_queries.ORACLE | problems.ORACLE
