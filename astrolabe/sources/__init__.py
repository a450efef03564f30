"""Declared schemas, delimited text, Parquet and the catalog."""
