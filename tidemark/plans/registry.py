"""Named queries over the driver tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_dir


@dataclass(frozen=True)
class Tables:
    """The tables of one folder, read lazily by attribute: ``t.events``."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``name``; ``covers`` lists the inventory ids it stands for."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(build, tuple(covers.split()), sql)
        return build

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shared_dir(spark)
    return QUERIES[name].build(Tables(spark, folder))


def r(expr: str, digits: int = 6) -> str:
    """SQL text that rounds like the Spark side does, without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"
