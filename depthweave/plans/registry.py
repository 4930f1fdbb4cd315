"""All queries of the market-data operators, and their SQL."""

from . import folded_sql, market, market_sql, sessions

QUERIES = market.QUERIES | sessions.QUERIES
SQL = market_sql.SQL | folded_sql.SQL | sessions.SQL
