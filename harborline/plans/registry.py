"""Named queries over the given tables, each with the ANSI SQL it must equal where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from harborline.sources.tables import table

Build = Callable[["Tables"], DataFrame]


class Tables:
    """The tables of one folder; each is read once and re-used within a query."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            self._seen[name] = table(self.spark, self.root, name)
        return self._seen[name]

    def sql(self, text: str, *names: str) -> DataFrame:
        """Spark SQL over the named tables, bound as DataFrames instead of session-wide views."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


@dataclass(frozen=True)
class Query:
    build: Build
    oracle: str | None

    def __call__(self, spark: SparkSession, root: str) -> DataFrame:
        return self.build(Tables(spark, root))


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, oracle)
        return build

    return add
