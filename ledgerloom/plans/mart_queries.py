"""Marts at their grains, measures over them, and checks on tables. The marts' expressions are inferred from their names,
grains and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..functions.temporal import utc_day, zoned_moment
from ..operators import quality
from ..registry import query
from ..session import table

_D = "(transaction_ts AT TIME ZONE 'UTC')::DATE"
_SALE = f"one_sale AS (SELECT sale_id, min({_D}) AS day, min(branch_id) AS branch_id FROM sale_header WHERE sale_id IS NOT NULL AND transaction_ts IS NOT NULL GROUP BY 1)"


def _one_sale(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "sale_header").filter("sale_id IS NOT NULL AND transaction_ts IS NOT NULL")
    return known.groupBy("sale_id").agg(F.min(utc_day("transaction_ts")).alias("day"), F.min("branch_id").alias("branch_id"))


@query(f"""WITH {_SALE}, d AS (SELECT {_D} AS day, product_id, sum(requested_units)::BIGINT AS requested, sum(fulfilled_units)::BIGINT AS fulfilled, sum(lost_units)::BIGINT AS lost, count(*) FILTER (outcome = 'OUT_OF_STOCK') AS stockouts FROM demand_attempt WHERE product_id IS NOT NULL AND transaction_ts IS NOT NULL GROUP BY 1, 2),
s AS (SELECT day, product_id, count(DISTINCT l.sale_id) AS transactions, count(DISTINCT branch_id) AS selling_branches, sum(quantity)::BIGINT AS units_sold, sum(net_sales_egp) AS net_sales, sum(gross_profit_egp) AS gross_profit FROM sale_line AS l JOIN one_sale USING (sale_id) WHERE product_id IS NOT NULL GROUP BY 1, 2)
SELECT day::VARCHAR AS day, product_id, coalesce(requested, 0) AS requested, coalesce(fulfilled, 0) AS fulfilled, coalesce(lost, 0) AS lost, coalesce(stockouts, 0) AS stockouts, CASE WHEN requested > 0 THEN round(fulfilled / requested, 6) END AS fill_rate,
  coalesce(transactions, 0) AS transactions, coalesce(selling_branches, 0) AS selling_branches, coalesce(units_sold, 0) AS units_sold, coalesce(net_sales, 0)::DECIMAL(26, 2) AS net_sales, coalesce(gross_profit, 0)::DECIMAL(26, 2) AS gross_profit FROM d FULL JOIN s USING (day, product_id)""")
def mart_product_daily_performance(spark: SparkSession, folder: str) -> DataFrame:
    """Demand and sales of each product and day (inferred); both sides folded to the grain before they meet."""
    own = ["day", "product_id"]
    asked = table(spark, folder, "demand_attempt").filter("product_id IS NOT NULL AND transaction_ts IS NOT NULL").groupBy(utc_day("transaction_ts").alias("day"), "product_id").agg(F.sum("requested_units").alias("requested"), F.sum("fulfilled_units").alias("fulfilled"), F.sum("lost_units").alias("lost"), F.count_if(F.col("outcome") == "OUT_OF_STOCK").alias("stockouts"))
    # one row a sale and product, then one a branch: distinct sales and branches become plain counts
    sums = {"units_sold": "quantity", "net_sales": "net_sales_egp", "gross_profit": "gross_profit_egp"}
    lines = table(spark, folder, "sale_line").filter("product_id IS NOT NULL").groupBy("sale_id", "product_id").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    again = [F.sum(n).alias(n) for n in sums]
    by_branch = lines.join(_one_sale(spark, folder), "sale_id").groupBy(*own, "branch_id").agg(F.count(F.lit(1)).alias("transactions"), *again)
    sold = by_branch.groupBy(*own).agg(F.sum("transactions").alias("transactions"), F.count("branch_id").alias("selling_branches"), *again)
    fill = rate(F.col("fulfilled"), F.col("requested"))
    counts = ["requested", "fulfilled", "lost", "stockouts", "transactions", "selling_branches", "units_sold"]
    money = [F.coalesce(c, F.lit(0).cast("decimal(26,2)")).cast("decimal(26,2)").alias(c) for c in ("net_sales", "gross_profit")]
    return asked.join(sold, own, "full").select(F.col("day").cast("string").alias("day"), "product_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], fill.alias("fill_rate"), *money)


_EVENTS = "ok AS (SELECT *, payload->>'$.branch_id' AS branch_id, payload->>'$.product_id' AS product_id, CASE WHEN regexp_matches(occurred_at, '(Z|[+-]\\d\\d:\\d\\d)$') THEN TRY_CAST(occurred_at AS TIMESTAMPTZ) END AS moment FROM bronze_event WHERE json_valid(payload))"


def _payloads(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    readable = F.get_json_object("payload", "$").isNotNull()
    return table(spark, folder, "bronze_event").filter((F.col("event_type") == kind) & readable).withColumn("moment", zoned_moment("occurred_at")).withColumn("day", utc_day("moment"))


def _field(name: str) -> F.Column:
    return F.get_json_object("payload", f"$.{name}")


@query(f"""WITH {_EVENTS} SELECT ((moment AT TIME ZONE 'UTC')::DATE)::VARCHAR AS day, branch_id, product_id, payload->>'$.channel' AS channel, sum(TRY_CAST(payload->>'$.requested_quantity' AS BIGINT))::BIGINT AS requested, sum(TRY_CAST(payload->>'$.fulfilled_quantity' AS BIGINT))::BIGINT AS fulfilled, count(*) AS lines, count(DISTINCT payload->>'$.basket_id') AS baskets
FROM ok WHERE event_type = 'sale.units_fulfilled' AND moment IS NOT NULL GROUP BY 1, 2, 3, 4""")
def fct_daily_sales_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Sale events by day, branch, product and channel (inferred)."""
    sales = _payloads(spark, folder, "sale.units_fulfilled").filter("moment IS NOT NULL")
    units = lambda n: F.sum(_field(n).try_cast("long"))
    return sales.groupBy(F.col("day").cast("string").alias("day"), _field("branch_id").alias("branch_id"), _field("product_id").alias("product_id"), _field("channel").alias("channel")).agg(units("requested_quantity").alias("requested"), units("fulfilled_quantity").alias("fulfilled"), F.count(F.lit(1)).alias("lines"), F.count_distinct(_field("basket_id")).alias("baskets"))


@query(f"""WITH {_EVENTS}, m AS (SELECT (moment AT TIME ZONE 'UTC')::DATE AS day, branch_id, product_id, TRY_CAST(payload->>'$.quantity_delta' AS BIGINT) AS delta, TRY_CAST(payload->>'$.on_hand_before' AS BIGINT) AS was, TRY_CAST(payload->>'$.on_hand_after' AS BIGINT) AS now_on, moment, kafka_topic, kafka_partition, kafka_offset
  FROM ok WHERE event_type = 'inventory.quantity_changed' AND moment IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY day, branch_id, product_id ORDER BY moment, kafka_topic, kafka_partition, kafka_offset) AS a, row_number() OVER (PARTITION BY day, branch_id, product_id ORDER BY moment DESC, kafka_topic DESC, kafka_partition DESC, kafka_offset DESC) AS b FROM m)
SELECT day::VARCHAR AS day, branch_id, product_id, max(CASE WHEN a = 1 THEN was END) AS opening, max(CASE WHEN b = 1 THEN now_on END) AS closing, count(*) AS movements, coalesce(sum(CASE WHEN delta > 0 THEN delta END), 0)::BIGINT AS units_in, coalesce(-sum(CASE WHEN delta < 0 THEN delta END), 0)::BIGINT AS units_out FROM r GROUP BY 1, 2, 3""")
def fct_daily_inventory_movement(spark: SparkSession, folder: str) -> DataFrame:
    """Opening and closing stock and units in and out by day, branch and product (inferred)."""
    delta = _field("quantity_delta").try_cast("long")
    place = F.struct("moment", "kafka_topic", "kafka_partition", "kafka_offset")
    moves = _payloads(spark, folder, "inventory.quantity_changed").filter("moment IS NOT NULL")
    units = lambda sign: F.coalesce(F.sum(F.when(delta * sign > 0, delta * sign)), F.lit(0).cast("long"))
    return moves.groupBy(F.col("day").cast("string").alias("day"), _field("branch_id").alias("branch_id"), _field("product_id").alias("product_id")).agg(F.min_by(_field("on_hand_before").try_cast("long"), place).alias("opening"), F.max_by(_field("on_hand_after").try_cast("long"), place).alias("closing"), F.count(F.lit(1)).alias("movements"), units(1).alias("units_in"), units(-1).alias("units_out"))


@query("""WITH ok AS (SELECT * FROM bronze_event WHERE json_valid(payload)), o AS (SELECT payload->>'$.supplier_id' AS supplier_id, count(*) AS orders, sum(TRY_CAST(payload->>'$.ordered_units' AS BIGINT))::BIGINT AS ordered, count(DISTINCT payload->>'$.branch_id') AS branches FROM ok WHERE event_type = 'purchase_order.created' GROUP BY 1),
r AS (SELECT payload->>'$.supplier_id' AS supplier_id, count(*) AS receipts, sum(TRY_CAST(payload->>'$.received_units' AS BIGINT))::BIGINT AS received FROM ok WHERE event_type = 'goods_receipt.received' GROUP BY 1)
SELECT supplier_id, coalesce(orders, 0) AS orders, coalesce(ordered, 0) AS ordered, coalesce(branches, 0) AS branches, coalesce(receipts, 0) AS receipts, coalesce(received, 0) AS received, CASE WHEN ordered > 0 THEN round(coalesce(received, 0) / ordered, 6) END AS receipt_rate FROM o FULL JOIN r USING (supplier_id) WHERE supplier_id IS NOT NULL""")
def q_sup_supplier_performance(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and receipts of each supplier (inferred), folded apart and then joined."""
    supplier = _field("supplier_id").alias("supplier_id")
    orders = _payloads(spark, folder, "purchase_order.created").groupBy(supplier).agg(F.count(F.lit(1)).alias("orders"), F.sum(_field("ordered_units").try_cast("long")).alias("ordered"), F.count_distinct(_field("branch_id")).alias("branches"))
    receipts = _payloads(spark, folder, "goods_receipt.received").groupBy(supplier).agg(F.count(F.lit(1)).alias("receipts"), F.sum(_field("received_units").try_cast("long")).alias("received"))
    joined = orders.join(receipts, "supplier_id", "full").filter("supplier_id IS NOT NULL")
    fill = F.when(F.col("ordered") > 0, F.round(F.coalesce("received", F.lit(0)) / F.col("ordered"), 6))
    return joined.select("supplier_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("orders", "ordered", "branches", "receipts", "received")], fill.alias("receipt_rate"))


@query("""SELECT count(*) AS line_rows, count(DISTINCT sale_id) AS transactions, sum(quantity)::BIGINT AS units, sum(gross_sales_egp) AS gross_sales, sum(discount_amount_egp) AS discounts, sum(net_sales_egp) AS net_sales, sum(cogs_egp) AS cogs, sum(gross_profit_egp) AS gross_profit,
  round(sum(gross_profit_egp)::DOUBLE / sum(net_sales_egp)::DOUBLE, 6) AS margin, round(sum(net_sales_egp)::DOUBLE / count(DISTINCT sale_id), 6) AS basket_value, count(*) FILTER (discount_amount_egp > 0) AS discounted_lines, count(DISTINCT product_id) AS products, round(avg(quantity), 6) AS average_quantity FROM sale_line""")
def bi_m_sales_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Measures over all lines as one row: sums, ratios, filtered and distinct counts, averages."""
    sums = {"gross_sales": "gross_sales_egp", "discounts": "discount_amount_egp", "net_sales": "net_sales_egp", "cogs": "cogs_egp", "gross_profit": "gross_profit_egp"}
    wide = table(spark, folder, "sale_line").agg(F.count(F.lit(1)).alias("line_rows"), F.count_distinct("sale_id").alias("transactions"), F.sum("quantity").alias("units"), *[F.sum(c).alias(n) for n, c in sums.items()], F.count_if(F.col("discount_amount_egp") > 0).alias("discounted_lines"), F.count_distinct("product_id").alias("products"), F.round(F.avg("quantity"), 6).alias("average_quantity"))
    return wide.withColumns({"margin": rate(F.col("gross_profit"), F.col("net_sales")), "basket_value": rate(F.col("net_sales"), F.col("transactions"))})


@query("""SELECT sale_line_id, copies FROM (SELECT sale_line_id, count(*) AS copies FROM sale_line GROUP BY 1) WHERE copies > 1""")
def dq_03_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line ids that stand more than once."""
    return quality.repeated_keys(table(spark, folder, "sale_line"), ["sale_line_id"])


@query("SELECT column_name, null_rows FROM (SELECT count(*) - count(sale_line_id) AS sale_line_id, count(*) - count(sale_id) AS sale_id, count(*) - count(product_id) AS product_id, count(*) - count(created_at) AS created_at FROM sale_line) UNPIVOT (null_rows FOR column_name IN (sale_line_id, sale_id, product_id, created_at))")
def dq_02_required_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls in columns that should have none."""
    return quality.null_counts(table(spark, folder, "sale_line"), ["sale_line_id", "sale_id", "product_id", "created_at"])


@query("SELECT product_id AS value, count(*) AS rows FROM sale_line AS l WHERE product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM master_product AS p WHERE p.product_id = l.product_id) GROUP BY 1")
def dq_01_orphan_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products of lines that the catalogue lacks, with their rows."""
    return quality.orphans(table(spark, folder, "sale_line"), "product_id", table(spark, folder, "master_product"), "product_id")


_RULES = {"net_is_gross_less_discount": "abs(gross_sales_egp - discount_amount_egp - net_sales_egp) <= 0.01", "profit_is_net_less_cost": "abs(net_sales_egp - cogs_egp - gross_profit_egp) <= 0.01", "quantity_positive": "quantity > 0", "discount_in_range": "discount_pct BETWEEN 0 AND 1"}


@query("SELECT rule, broken_rows FROM (SELECT " + ", ".join(f"count(*) FILTER (({r}) IS NOT TRUE) AS {n}" for n, r in _RULES.items()) + f" FROM sale_line) UNPIVOT (broken_rows FOR rule IN ({', '.join(_RULES)}))")
def dq_01_line_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose amounts don't add up, by rule."""
    return quality.broken_rules(table(spark, folder, "sale_line"), {n: F.expr(r) for n, r in _RULES.items()})


@query("""SELECT 'sale_line_unique' AS check_name, count(*) AS rows_found, count(*) = 0 AS passed FROM (SELECT sale_line_id FROM sale_line GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'branch_unique', count(*), count(*) = 0 FROM (SELECT branch_id FROM pharmacy_branch GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'sales_have_branches', count(*), count(*) = 0 FROM (SELECT DISTINCT branch_id FROM sale_header WHERE branch_id IS NOT NULL EXCEPT SELECT branch_id FROM pharmacy_branch)""")
def dq_04_health_report(spark: SparkSession, folder: str) -> DataFrame:
    """Checks that should find nothing, with what they found."""
    return quality.report({
        "sale_line_unique": quality.repeated_keys(table(spark, folder, "sale_line"), ["sale_line_id"]),
        "branch_unique": quality.repeated_keys(table(spark, folder, "pharmacy_branch"), ["branch_id"]),
        "sales_have_branches": quality.orphans(table(spark, folder, "sale_header"), "branch_id", table(spark, folder, "pharmacy_branch"), "branch_id"),
    })
