"""The SQL entry point: registered tables, the dialect, plans and timed runs."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import dialect, star


@dataclass
class Run:
    """What execute() returns: the rows, their columns, and seconds for planning and running."""

    columns: list[str]
    rows: list
    plan_s: float
    run_s: float


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def register(self, tables: dict[str, DataFrame]) -> Engine:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return self

    def register_folder(self, folder: str, names: tuple[str, ...] = star.SOURCES) -> Engine:
        return self.register({n: self.spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    def register_star(self, folder: str) -> Engine:
        """The star of a folder, stored once a session."""
        return self.register(star.at(self.spark, folder))

    def translate(self, sql: str) -> str:
        return dialect.translate(sql)

    def sql(self, sql: str) -> DataFrame:
        return self.spark.sql(dialect.translate(sql))

    def explain(self, sql: str, mode: str = "formatted") -> str:
        df = self.sql(sql)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def execute(self, sql: str) -> Run:
        """Runs a query whose result is small enough for the driver, as an interactive shell does."""
        began = time.perf_counter()
        df = self.sql(sql)
        columns = df.columns
        planned = time.perf_counter()
        rows = df.collect()
        return Run(columns, rows, planned - began, time.perf_counter() - planned)
