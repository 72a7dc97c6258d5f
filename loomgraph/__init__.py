"""Spark jobs that turn documents and tables into a clean, queryable knowledge graph."""
