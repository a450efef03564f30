"""Delimited text in, Parquet out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITER = "|"


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_text(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = DELIMITER, empty_as_zero: bool = False) -> DataFrame:
    """Rows of a header-less text file; a delimiter at the end of lines is optional, and each line may differ.

    Empty fields are null, or zero and "" with empty_as_zero; empty lines are no rows. A line with too many or too few fields, or a
    field that does not parse as its type, fails the read, whatever the session's settings.
    """
    n = len(schema)
    fields = F.split("value", re.escape(delimiter), -1)
    bare = F.when(F.element_at(fields, -1) == "", F.slice(fields, 1, n)).otherwise(fields)
    right = (F.size(fields) == n) | ((F.size(fields) == n + 1) & (F.element_at(fields, -1) == ""))
    wrong = F.raise_error(F.concat(F.lit(f"a line should have {n} fields: "), F.col("value"))).cast("array<string>")
    lines = spark.read.text(path).where(F.length("value") > 0).select(F.when(right, F.when(F.size(fields) == n, fields).otherwise(bare)).otherwise(wrong).alias("fields"))
    cells = []
    for k, f in enumerate(schema):
        text = F.element_at("fields", k + 1)
        text = F.when(text != "", text)
        cell = text.try_cast(f.dataType)
        bad = F.raise_error(F.concat(F.lit(f"{f.name} should be {f.dataType.simpleString()}: "), text)).cast(f.dataType)
        cell = F.when(cell.isNull() & text.isNotNull(), bad).otherwise(cell)
        if empty_as_zero:
            cell = F.coalesce(cell, F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType))
        cells.append(cell.alias(f.name, metadata=f.metadata))
    return lines.select(*cells)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_text(df: DataFrame, path: str, delimiter: str = DELIMITER, trailing: bool = False, mode: str = "overwrite") -> None:
    """One line a row; nulls are empty fields. A value that holds the delimiter or a line end fails the write, as it could not be
    read back."""
    cells = []
    for f in df.schema:
        cell = F.coalesce(_column(f.name).cast("string"), F.lit(""))
        if isinstance(f.dataType, T.StringType):
            unfit = reduce(Column.__or__, (F.contains(cell, F.lit(x)) for x in (delimiter, "\n", "\r")))
            cell = F.when(unfit, F.raise_error(F.concat(F.lit(f"{f.name} cannot be written as text: "), cell)).cast("string")).otherwise(cell)
        cells.append(cell)
    line = F.concat_ws(delimiter, *cells, *([F.lit("")] if trailing else []))
    df.select(line.alias("value")).write.mode(mode).text(path)


def cluster(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Range-partitions and sorts by keys, so that written files and row groups have narrow key ranges to prune by."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)
