"""Operators over DataFrames: joins, comparisons with tables, grouping."""
