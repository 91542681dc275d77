"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.plans.tables import derived, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

C = F.col
KEYS = ("seq_name", "frame_idx")


def query(name: str, sql: str | None = None, *tables: str):
    """Register a function of the named derived tables; sql selects the same from them."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*derived(spark, sf_dir, *tables))
        if sql is not None:
            ORACLE_SQL[name] = with_sql(sql, *tables)
        return f

    return register


def r6(c: Column, name: str) -> Column:
    """Six decimals; + 0.0 makes of a negative zero a positive one."""
    return (F.round(c, 6) + 0.0).alias(name)
