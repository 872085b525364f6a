"""Named plans: the registered queries and their DuckDB oracle SQL."""
