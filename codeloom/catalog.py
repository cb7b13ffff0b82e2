"""A set of named DataFrames that the operators read; nothing is executed here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .schema import SCHEMAS


class Catalog:
    """Tables by name. One that isn't given is empty, with its declared schema; one given as a function is made when it is first asked for."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark = spark
        self.tables = dict(tables or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            if name not in SCHEMAS:
                raise ValueError(f"unknown table {name!r}")
            self.tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        elif callable(self.tables[name]):
            self.tables[name] = self.tables[name]()
        return self.tables[name]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Catalog":
        """From the folder that ``sources.ingest`` has written; each table is a Parquet folder."""
        return cls(spark, {name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in SCHEMAS.items()})

    def save(self, path: str, mode: str = "overwrite") -> None:
        for name in SCHEMAS:
            self[name].write.mode(mode).parquet(f"{path}/{name}")

    def register(self) -> "Catalog":
        """Temporary views under the tables' names, for plain SQL."""
        for name in SCHEMAS:
            self[name].createOrReplaceTempView(name)
        return self

    def sql(self, query: str, args: dict | None = None) -> DataFrame:
        """R11: SQL with named parameters (:name) over the views."""
        self.register()
        return self.spark.sql(query, args=args or {})
