"""Model plans (fit and score) and the catalogue of queries with their SQL."""
