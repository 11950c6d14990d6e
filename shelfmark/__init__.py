"""Catalog intelligence on Spark: DataFrame, SQL and Structured Streaming operators."""
