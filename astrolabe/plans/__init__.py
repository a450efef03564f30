"""The star schema, the benchmark, the SQL dialect, the engine and the named queries."""
