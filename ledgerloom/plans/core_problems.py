"""Queries of the general large-scale problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import column_profile as cp
from ..operators.even_totals import heavy_keys, key_totals, totals_once
from ..operators.known_time import known_at
from ..operators.late_events import beyond_cutoff, revisions
from ..operators.single_delivery import repeated_deliveries, single_deliveries
from ..operators.trailing import idle_days, trailing_totals
from ..session import cut, table

PRODUCT_RULES = [
    cp.Rule("retail_price_egp", above=0, at_most=100_000, level_factor=3),
    cp.Rule("manufacturer", names=True, broken_share=0.25, single_share=0.5),
]
RUN_RULES = [cp.Rule("input_row_counts", pattern=cp.PLAIN_COUNTS, sound=cp.PLAIN_COUNT_SIGNS)]
PROFILED = (("master_product", "product_id", PRODUCT_RULES, "source_snapshot_label"), ("ingestion_run", "run_id", RUN_RULES, None))
POSITION = ["kafka_topic", "kafka_partition", "kafka_offset"]


RULES = [*PRODUCT_RULES, *RUN_RULES]


def _valued(spark: SparkSession, folder: str) -> DataFrame:
    """The judged values of all profiled columns; read several times, so written."""
    (first, _, rules, load), (second, _, others, no_load) = PROFILED
    counts = cp.value_counts(table(spark, folder, first), rules, load, cp.loaded_values(table(spark, folder, second), others, no_load))
    return cut(cp.valued(counts, RULES))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values and loads of the profiled columns that are out of order."""
    values = _valued(spark, folder)
    parts = [cp.keyed_values(table(spark, folder, name), key, rules).withColumn("table_name", F.lit(name)) for name, key, rules, _ in PROFILED]
    broken = values.filter("broken").select("column_name", "value", "row_count")
    records = cp.records_of(parts[0].unionByName(parts[1]), broken).select("table_name", "column_name", "record_key")
    # written whole, with the comparison of coverage
    profile = cut(cp.profile(cp.by_load(values), RULES))
    loads = profile.filter("out_of_order AND load IS NOT NULL").select(F.lit("master_product").alias("table_name"), "column_name", F.col("load").alias("record_key"))
    return records.unionByName(loads)


def p1_column_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of each column by load; ingestion_run as one load."""
    of = F.when(F.col("column_name").isin([r.column for r in RUN_RULES]), "ingestion_run").otherwise("master_product")
    return cp.profile(cp.by_load(_valued(spark, folder)), RULES).withColumn("table_name", of)


def p1_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    """The profile's figures that SQL has too."""
    kept = ["table_name", "column_name", "load", "rows", "null_rows", "distinct_values", "broken_rows", "out_of_order"]
    return p1_column_profile(spark, folder).select(*kept, F.round("median", 4).alias("median"))


def p1_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """The induced expressions with the rows and distinct values they cover; a null expression has the exceptions."""
    of = F.when(F.col("column_name").isin([r.column for r in RUN_RULES]), "ingestion_run").otherwise("master_product")
    known = _valued(spark, folder).filter("value IS NOT NULL")
    return known.groupBy(of.alias("table_name"), "column_name", "expression").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("row_count").alias("covered_rows"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records beyond the cut-off."""
    return beyond_cutoff(table(spark, folder, "bronze_event"), POSITION)


def p2_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every corrected count per event type and day."""
    return revisions(table(spark, folder, "bronze_event")).select("event_type", F.col("event_day").cast("string").alias("event_day"), F.col("arrival_day").cast("string").alias("arrival_day"), "arrived", "corrected_total", "revision", "is_latest")


def _demand(spark: SparkSession, folder: str) -> DataFrame:
    return trailing_totals(table(spark, folder, "demand_attempt"), "product_id", "transaction_ts", "requested_units", (7, 30), record_id="demand_attempt_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days within a product's span whose last 30 days had no demand."""
    return idle_days(_demand(spark, folder), "product_id", 30).select("product_id", F.col("day").cast("string").alias("demand_day"))


def p3_trailing_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and daily averages over the last 7 and 30 days, each attempt once."""
    return _demand(spark, folder).withColumn("day", F.col("day").cast("string"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of an event but its first."""
    return repeated_deliveries(table(spark, folder, "bronze_event"), POSITION, order=["kafka_timestamp", *POSITION])


def p4_single_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """One record of each event, stored batches and the newest one together."""
    records = table(spark, folder, "bronze_event")
    newest = records.agg(F.max("batch_id").alias("b")).first()["b"]
    stored, new = records.filter(~F.coalesce(F.col("batch_id") == newest, F.lit(False))), records.filter(F.col("batch_id") == newest)
    return single_deliveries(stored, new, order=["kafka_timestamp", *POSITION]).select(*POSITION, "event_id", "recorded_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that hold at least one in 25 of all rows as delivered."""
    parts = [heavy_keys(table(spark, folder, name), key, 25).select(F.lit(name).alias("table_name"), F.lit(key).alias("column_name"), "key_value") for name, key in (("sale_line", "product_id"), ("sale_header", "branch_id"))]
    return parts[0].unionByName(parts[1])


_SOLD = (("sale_line", "product_id", "sale_line_id"), ("sale_header", "branch_id", "sale_id"))
_AMOUNTS = ["net_sales_egp", "gross_profit_egp"]


def p5_sales_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Sales totals per product and branch, rows as delivered."""
    parts = [key_totals(table(spark, folder, name), key, _AMOUNTS).select(F.lit(name).alias("table_name"), F.lit(key).alias("column_name"), "*") for name, key, _ in _SOLD]
    return parts[0].unionByName(parts[1])


def p5_totals_of_reloads_once(spark: SparkSession, folder: str) -> DataFrame:
    """Sales totals per product and branch, reloaded rows once."""
    parts = [totals_once(table(spark, folder, name), key, _AMOUNTS, row_id).select(F.lit(name).alias("table_name"), F.lit(key).alias("column_name"), "*") for name, key, row_id in _SOLD]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each attempt with the price observation valid and known at its moment."""
    return known_at(table(spark, folder, "demand_attempt"), table(spark, folder, "product_price_history"), "demand_attempt_id", "product_id", "transaction_ts", "price_observation_id", "price_egp", "observed_at", "loaded_at")


QUERIES = {f.__name__: f for f in (p1_found, p1_column_profile, p1_aggregates, p1_expressions, p2_found, p2_revisions, p3_found, p3_trailing_totals, p4_found, p4_single_deliveries, p5_found, p5_sales_totals, p5_totals_of_reloads_once, p6_found)}
