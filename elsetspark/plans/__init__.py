"""plans of the engine: driver queries and their SQL."""

from . import oracle, partition_queries, queries

QUERIES = queries.QUERIES | partition_queries.QUERIES
SQL = oracle.SQL | partition_queries.SQL
