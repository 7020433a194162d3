"""Queries by name, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order lines read as measurements of cells; the same text in Spark and DuckDB.
MEASUREMENTS = """SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_shipdate AS date), cast(round(l_extendedprice*100) AS bigint)) AS measurement_id,
  concat('s', l_suppkey % 6) AS source_key, l_partkey AS food_id, concat(l_returnflag, l_linestatus) AS axis_id, l_suppkey AS profile_id,
  l_quantity AS value, l_discount AS ratio, l_extendedprice AS price, substr('ABCD', 1 + (l_linenumber % 4), 1) AS quality_tier, l_linenumber AS sample_count FROM lineitem"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MEASUREMENTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def m(sql: str) -> str:
    """SQL after the measurements' common table, named m."""
    return f"WITH m AS ({MEASUREMENTS}){',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
