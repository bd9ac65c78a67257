"""Series built from tables, and the catalogue of queries with their SQL."""
