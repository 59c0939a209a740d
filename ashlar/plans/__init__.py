"""Plans: operators put together, and the registry of queries with their SQL."""
