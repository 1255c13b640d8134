"""Checks on tables: what must not be null, what must be unique, what must refer to something, what must add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, null_rows) of each required column, in one pass."""
    counted = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "null_rows")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once, with how often; null keys are equal."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def orphans(rows: DataFrame, column: str, of: DataFrame, key: str) -> DataFrame:
    """(value, rows) of non-null values that the other table lacks; values are counted before the join."""
    values = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return values.join(of.select(F.col(key).alias("value")), "value", "left_anti")


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, broken_rows): rows for which a rule isn't true, nulls included; one pass for all rules."""
    counted = rows.agg(*[F.count_if(~F.coalesce(holds, F.lit(False))).alias(name) for name, holds in rules.items()])
    return counted.unpivot([], list(rules), "rule", "broken_rows")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, rows_found, passed) of queries that should find nothing."""
    one = [found.agg(F.count(F.lit(1)).alias("rows_found")).select(F.lit(name).alias("check_name"), "rows_found", (F.col("rows_found") == 0).alias("passed")) for name, found in checks.items()]
    return reduce(DataFrame.unionByName, one)


def minimum_rows(counted: dict[str, DataFrame], least: dict, basis: DataFrame) -> DataFrame:
    """(table_name, rows, least_rows, enough): one-row counts against what ``least`` makes of the one row of ``basis``."""
    one = [count.join(basis).select(F.lit(name).alias("table_name"), "rows", least[name]().cast("long").alias("least_rows")) for name, count in counted.items()]  # one row each
    return reduce(DataFrame.unionByName, one).withColumn("enough", F.col("rows") >= F.col("least_rows"))
