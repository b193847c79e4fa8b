"""Plans: the catalog of metric families and the queries built on it."""
