"""The subpackage's queries and their SQL."""

from tidewatch.llm import queries

QUERIES = queries.QUERIES
ORACLES = queries.ORACLES
