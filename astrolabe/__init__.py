"""A star-schema analytics engine on PySpark."""
