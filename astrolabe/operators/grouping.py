"""Grouping helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """GROUP BY GROUPING SETS; key columns in the order in which they first appear."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggregates)


def global_aggregate(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row, also of no rows; sums of nothing are null and counts 0."""
    return df.agg(*aggregates)


def having(df: DataFrame, keys: Sequence[str | Column], aggregates: Sequence[Column], test: Column) -> DataFrame:
    """Groups whose keys and aggregates pass a test; Catalyst moves tests of keys alone below the aggregation."""
    return df.groupBy(*keys).agg(*aggregates).where(test)
