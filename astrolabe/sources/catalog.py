"""Databases of declared tables: create, delete, list, restore, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import delimited, schema, scratch


class Catalog:
    """Databases under a root folder that Spark can write to: <root>/<database>/<table> as Parquet, and the schema text.

    All reads and writes go through Spark, so the root may be in any store that Spark reads.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, database: str, table: str = "") -> str:
        if not database.replace("_", "").isalnum():
            raise ValueError(f"not a database name: {database!r}")
        return f"{self.root}/{database.lower()}" + (f"/{table.lower()}" if table else "")

    def create(self, database: str, schema_text: str) -> dict[str, T.StructType]:
        tables = schema.parse(schema_text)
        home = self._path(database, "_declared")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database.lower()}")
        self.spark.createDataFrame([(schema.to_text(tables),)], "text string").coalesce(1).write.mode("overwrite").text(home)
        for name, struct in tables.items():
            self.spark.createDataFrame([], struct).write.mode("overwrite").parquet(self._path(database, name))
            self._register(database, name)
        return tables

    def _register(self, database: str, table: str) -> None:
        name = f"{database.lower()}.{table.lower()}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{self._path(database, table)}'")

    def delete(self, database: str) -> None:
        """Drops the database and its files."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {database.lower()} CASCADE")
        scratch.delete(self.spark, self._path(database))

    def list(self, database: str) -> list[str]:
        """The database's own tables; temporary views of the session belong to none."""
        rows = self.spark.sql(f"SHOW TABLES IN {database.lower()}").where("not isTemporary").collect()
        return sorted(r.tableName for r in rows)

    def declared(self, database: str) -> dict[str, T.StructType]:
        rows = self.spark.read.option("wholetext", True).text(self._path(database, "_declared")).collect()
        return schema.parse("\n".join(r.value for r in rows))

    def restore(self, database: str) -> list[str]:
        """Registers the tables of a database whose files exist, from its saved schema text."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database.lower()}")
        for name in self.declared(database):
            self._register(database, name)
        return self.list(database)

    def load(self, database: str, table: str, path: str, delimiter: str = delimited.DELIMITER, cluster_by: tuple[str, ...] = ()) -> DataFrame:
        """Loads delimited text into a table, clustered by keys if asked."""
        struct = self.declared(database)[table.lower()]
        rows = delimited.read_text(self.spark, path, struct, delimiter)
        if cluster_by:
            rows = delimited.cluster(rows, *cluster_by)
        delimited.write_parquet(rows, self._path(database, table))
        self.spark.sql(f"REFRESH TABLE {database.lower()}.{table.lower()}")
        return self.spark.table(f"{database.lower()}.{table.lower()}")
