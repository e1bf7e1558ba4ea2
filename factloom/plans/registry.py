"""Queries over the driver's tables: a callable and, where SQL can express it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A fixed present, so that results do not depend on the day.
NOW = 1_700_000_000


#: Tables of long texts, whose rows are worth dealing over all cores even where they stand in one file.
TEXTS = ("documents", "pages")


class Tables:
    """Tables of a data folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        found = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return spread(found) if name in TEXTS else found


def query(sql: str | None = None):
    """Registers ``f(tables) -> DataFrame`` under its name."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def seconds(column: str) -> Column:
    """Epoch seconds of a time without zone, whatever the session's zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz")) / 1_000_000).cast("long")
