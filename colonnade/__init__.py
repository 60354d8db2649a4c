"""Colonnade: typed columnar tables with filters, joins, aggregates and vector search on Spark."""
