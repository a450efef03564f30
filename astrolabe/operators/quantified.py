"""Comparisons with all or some values of another table, by joins."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIGNS: dict[str, Callable[[Column, Column], Column]] = {
    "=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}


def _extremes(values: DataFrame, column: str) -> DataFrame:
    """One row: least, greatest, count of all and of nulls."""
    return values.agg(
        F.min(column).alias("_least"), F.max(column).alias("_most"), F.count(F.lit(1)).alias("_all"), F.sum(F.col(column).isNull().cast("long")).alias("_nulls")
    )


def compare_any(df: DataFrame, left: Column, sign: str, values: DataFrame, column: str) -> DataFrame:
    """Rows for which `left sign ANY (values)` is true."""
    if sign == "=":
        keys = values.select(F.col(column).alias("_value")).distinct()
        return df.join(keys, left == F.col("_value"), "left_semi")
    # one row of extremes decides: < ANY is < the greatest, and so on; <> ANY is false only if all equal left
    bound = F.broadcast(_extremes(values, column))
    test = (left != F.col("_least")) | (left != F.col("_most")) if sign == "<>" else _SIGNS[sign](left, F.col("_most" if sign[0] == "<" else "_least"))
    return df.join(bound, test, "left_semi")


def compare_all(df: DataFrame, left: Column, sign: str, values: DataFrame, column: str) -> DataFrame:
    """Rows for which `left sign ALL (values)` is true: also if there is no value, and not if one is null."""
    bound = F.broadcast(_extremes(values, column))
    empty, known = F.col("_all") == 0, F.coalesce(F.col("_nulls"), F.lit(0)) == 0
    if sign == "<>":
        keys = values.select(F.col(column).alias("_value")).distinct()
        passed = df.join(keys, left == F.col("_value"), "left_anti")
        return passed.join(bound, empty | (known & left.isNotNull()), "left_semi")
    test = (left == F.col("_least")) & (left == F.col("_most")) if sign == "=" else _SIGNS[sign](left, F.col("_least" if sign[0] == "<" else "_most"))
    return df.join(bound, empty | (known & test), "left_semi")
