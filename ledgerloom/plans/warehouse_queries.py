"""Marts, dimensions and views of the warehouse at their grains, tests and health checks over them, and its measures.

Expressions of marts are inferred from their names, grains and invariants."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..functions.temporal import utc_day
from ..operators import quality
from ..registry import query
from ..session import table
from .feature_queries import _BALANCES, _closing
from .mart_queries import _EVENTS, _SALE, _field, _one_sale, _payloads, fct_daily_inventory_movement, fct_daily_sales_demand, mart_product_daily_performance
from .relational_queries import jn_19_order_lifecycle



def _zero() -> Column:
    return F.lit(0).cast("long")


def _no_money() -> Column:
    return F.lit(0).cast("decimal(26,2)")


def _sum(name: str) -> Column:
    return F.sum(_field(name).try_cast("long"))


_SOLD_DAYS = """sd AS (SELECT (moment AT TIME ZONE 'UTC')::DATE AS day, branch_id, product_id, payload->>'$.channel' AS channel, count(*) AS demand_lines, count(DISTINCT payload->>'$.basket_id') AS baskets,
  sum(TRY_CAST(payload->>'$.requested_quantity' AS BIGINT))::BIGINT AS requested, sum(TRY_CAST(payload->>'$.fulfilled_quantity' AS BIGINT))::BIGINT AS fulfilled, sum(TRY_CAST(payload->>'$.lost_quantity' AS BIGINT))::BIGINT AS lost
  FROM ok WHERE event_type = 'sale.units_fulfilled' AND moment IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_MOVED_DAYS = """mv AS (SELECT (moment AT TIME ZONE 'UTC')::DATE AS day, branch_id, product_id, count(*) AS movements, coalesce(sum(TRY_CAST(payload->>'$.quantity_delta' AS BIGINT)) FILTER (TRY_CAST(payload->>'$.quantity_delta' AS BIGINT) > 0), 0)::BIGINT AS units_in,
  coalesce(-sum(TRY_CAST(payload->>'$.quantity_delta' AS BIGINT)) FILTER (TRY_CAST(payload->>'$.quantity_delta' AS BIGINT) < 0), 0)::BIGINT AS units_out FROM ok WHERE event_type = 'inventory.quantity_changed' AND moment IS NOT NULL GROUP BY 1, 2, 3)"""
_REORDERS = """ro AS (SELECT event_id, (moment AT TIME ZONE 'UTC')::DATE AS day, branch_id, product_id, TRY_CAST(payload->>'$.available_quantity' AS BIGINT) AS available_quantity, TRY_CAST(payload->>'$.reorder_point' AS BIGINT) AS reorder_point,
  TRY_CAST(payload->>'$.target_stock_level' AS BIGINT) AS target_stock_level, TRY_CAST(payload->>'$.recommended_reorder_quantity' AS BIGINT) AS recommended, kafka_topic, kafka_partition, kafka_offset, moment FROM ok WHERE event_type = 'inventory.reorder_required' AND moment IS NOT NULL)"""


def _sold_days(spark: SparkSession, folder: str) -> DataFrame:
    sales = _payloads(spark, folder, "sale.units_fulfilled").filter("moment IS NOT NULL")
    return sales.groupBy("day", _field("branch_id").alias("branch_id"), _field("product_id").alias("product_id")).agg(_sum("requested_quantity").alias("requested"), _sum("fulfilled_quantity").alias("fulfilled"), _sum("lost_quantity").alias("lost"), F.count(F.lit(1)).alias("demand_lines"))


def _moved_days(spark: SparkSession, folder: str) -> DataFrame:
    delta = _field("quantity_delta").try_cast("long")
    units = lambda sign: F.coalesce(F.sum(F.when(delta * sign > 0, delta * sign)), _zero())
    moves = _payloads(spark, folder, "inventory.quantity_changed").filter("moment IS NOT NULL")
    return moves.groupBy("day", _field("branch_id").alias("branch_id"), _field("product_id").alias("product_id")).agg(F.count(F.lit(1)).alias("movements"), units(1).alias("units_in"), units(-1).alias("units_out"))


def _reorders(spark: SparkSession, folder: str) -> DataFrame:
    number = lambda name: _field(name).try_cast("long")
    events = _payloads(spark, folder, "inventory.reorder_required").filter("moment IS NOT NULL")
    return events.select("event_id", "day", "moment", _field("branch_id").alias("branch_id"), _field("product_id").alias("product_id"), number("available_quantity").alias("available_quantity"), number("reorder_point").alias("reorder_point"), number("target_stock_level").alias("target_stock_level"), number("recommended_reorder_quantity").alias("recommended"), "kafka_topic", "kafka_partition", "kafka_offset")


@query(f"WITH {_EVENTS}, {_REORDERS} SELECT event_id, day::VARCHAR AS day, branch_id, product_id, available_quantity, reorder_point, target_stock_level, recommended, kafka_topic, kafka_partition, kafka_offset FROM ro")
def fct_reorder_events(spark: SparkSession, folder: str) -> DataFrame:
    """Reorders as they were reported, one row an event."""
    return _reorders(spark, folder).withColumn("day", F.col("day").cast("string")).drop("moment")


@query(f"""WITH {_EVENTS}, {_SOLD_DAYS}, {_MOVED_DAYS}, {_REORDERS}, a AS (SELECT day, branch_id, sum(requested)::BIGINT AS requested, sum(fulfilled)::BIGINT AS fulfilled, sum(lost)::BIGINT AS lost, sum(demand_lines)::BIGINT AS demand_lines FROM sd GROUP BY 1, 2),
b AS (SELECT day, branch_id, sum(movements)::BIGINT AS movements, sum(units_in)::BIGINT AS units_in, sum(units_out)::BIGINT AS units_out FROM mv GROUP BY 1, 2), c AS (SELECT day, branch_id, count(*) AS reorders, sum(recommended)::BIGINT AS reordered FROM ro GROUP BY 1, 2),
k AS (SELECT day, branch_id FROM a UNION SELECT day, branch_id FROM b UNION SELECT day, branch_id FROM c)
SELECT k.day::VARCHAR AS day, k.branch_id, coalesce(requested, 0) AS requested, coalesce(fulfilled, 0) AS fulfilled, coalesce(lost, 0) AS lost, coalesce(demand_lines, 0) AS demand_lines, coalesce(movements, 0) AS movements, coalesce(units_in, 0) AS units_in, coalesce(units_out, 0) AS units_out,
  coalesce(reorders, 0) AS reorders, coalesce(reordered, 0) AS reordered, CASE WHEN requested > 0 THEN round(fulfilled / requested, 6) END AS fill_rate FROM k LEFT JOIN a USING (day, branch_id) LEFT JOIN b USING (day, branch_id) LEFT JOIN c USING (day, branch_id) WHERE branch_id IS NOT NULL""")
def mart_branch_daily_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Sales, movements and reorders of each branch and day (inferred): three facts, each folded to the grain first."""
    own = ["day", "branch_id"]
    total = lambda names: [F.sum(n).alias(n) for n in names]
    sold = _sold_days(spark, folder).groupBy(*own).agg(*total(["requested", "fulfilled", "lost", "demand_lines"]))
    moved = _moved_days(spark, folder).groupBy(*own).agg(*total(["movements", "units_in", "units_out"]))
    asked = _reorders(spark, folder).groupBy(*own).agg(F.count(F.lit(1)).alias("reorders"), F.sum("recommended").alias("reordered"))
    joined = sold.join(moved, own, "full").join(asked, own, "full").filter("branch_id IS NOT NULL")
    counts = ["requested", "fulfilled", "lost", "demand_lines", "movements", "units_in", "units_out", "reorders", "reordered"]
    return joined.select(F.col("day").cast("string").alias("day"), "branch_id", *[F.coalesce(c, _zero()).alias(c) for c in counts], rate(F.col("fulfilled"), F.col("requested")).alias("fill_rate"))


@query(f"WITH {_EVENTS}, {_SOLD_DAYS} SELECT day::VARCHAR AS day, product_id, sum(requested)::BIGINT AS requested, sum(fulfilled)::BIGINT AS fulfilled, sum(lost)::BIGINT AS lost, sum(demand_lines)::BIGINT AS demand_lines, count(DISTINCT branch_id) AS branches FROM sd GROUP BY 1, 2")
def mart_product_daily_demand(spark: SparkSession, folder: str) -> DataFrame:
    """The sales fact rolled up to products and days (inferred)."""
    total = [F.sum(n).alias(n) for n in ("requested", "fulfilled", "lost", "demand_lines")]
    return _sold_days(spark, folder).groupBy(F.col("day").cast("string").alias("day"), "product_id").agg(*total, F.count_distinct("branch_id").alias("branches"))


_DAY = "(transaction_ts AT TIME ZONE 'UTC')::DATE"
_BRANCH_DAYS = f"""bd AS (SELECT coalesce(d.day, h.day, l.day) AS day, coalesce(d.branch_id, h.branch_id, l.branch_id) AS branch_id, * EXCLUDE (day, branch_id) FROM
  (SELECT {_DAY} AS day, branch_id, sum(requested_units)::BIGINT AS requested, sum(fulfilled_units)::BIGINT AS fulfilled, sum(lost_units)::BIGINT AS lost, count(*) FILTER (outcome = 'OUT_OF_STOCK') AS stockout_attempts FROM demand_attempt WHERE branch_id IS NOT NULL AND transaction_ts IS NOT NULL GROUP BY 1, 2) AS d
  FULL JOIN (SELECT day, branch_id, count(*) AS transactions FROM one_sale WHERE branch_id IS NOT NULL GROUP BY 1, 2) AS h ON d.day = h.day AND d.branch_id = h.branch_id
  FULL JOIN (SELECT day, branch_id, sum(quantity)::BIGINT AS units_sold, sum(net_sales_egp) AS net_sales, sum(cogs_egp) AS cogs, sum(gross_profit_egp) AS gross_profit FROM sale_line JOIN one_sale USING (sale_id) WHERE branch_id IS NOT NULL GROUP BY 1, 2) AS l ON coalesce(d.day, h.day) = l.day AND coalesce(d.branch_id, h.branch_id) = l.branch_id)"""


def _branch_days(spark: SparkSession, folder: str) -> DataFrame:
    own = ["day", "branch_id"]
    asked = table(spark, folder, "demand_attempt").filter("branch_id IS NOT NULL AND transaction_ts IS NOT NULL").groupBy(utc_day("transaction_ts").alias("day"), "branch_id").agg(F.sum("requested_units").alias("requested"), F.sum("fulfilled_units").alias("fulfilled"), F.sum("lost_units").alias("lost"), F.count_if(F.col("outcome") == "OUT_OF_STOCK").alias("stockout_attempts"))
    sales = _one_sale(spark, folder).filter("branch_id IS NOT NULL")
    made = sales.groupBy(*own).agg(F.count(F.lit(1)).alias("transactions"))
    # lines are folded to their sale before they meet it
    lines = table(spark, folder, "sale_line").groupBy("sale_id").agg(F.sum("quantity").alias("units_sold"), *[F.sum(f"{c}_egp").alias(c) for c in ("net_sales", "cogs", "gross_profit")])
    sold = lines.join(sales, "sale_id").groupBy(*own).agg(*[F.sum(c).alias(c) for c in ("units_sold", "net_sales", "cogs", "gross_profit")])
    return asked.join(made, own, "full").join(sold, own, "full")


@query(f"""WITH {_SALE}, {_BRANCH_DAYS} SELECT bd.day::VARCHAR AS day, branch_id, branch_code, governorate, coalesce(requested, 0) AS requested, coalesce(fulfilled, 0) AS fulfilled, coalesce(lost, 0) AS lost, coalesce(stockout_attempts, 0) AS stockout_attempts, coalesce(transactions, 0) AS transactions, coalesce(units_sold, 0) AS units_sold,
  coalesce(net_sales, 0)::DECIMAL(26, 2) AS net_sales, coalesce(cogs, 0)::DECIMAL(26, 2) AS cogs, coalesce(gross_profit, 0)::DECIMAL(26, 2) AS gross_profit, CASE WHEN requested > 0 THEN round(fulfilled / requested, 6) END AS fill_rate FROM bd LEFT JOIN pharmacy_branch USING (branch_id)""")
def mart7h_branch_daily_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Demand and sales of each branch and day with the branch's names (inferred)."""
    branches = table(spark, folder, "pharmacy_branch").select("branch_id", "branch_code", "governorate")
    counts = [F.coalesce(c, _zero()).alias(c) for c in ("requested", "fulfilled", "lost", "stockout_attempts", "transactions", "units_sold")]
    money = [F.coalesce(c, _no_money()).cast("decimal(26,2)").alias(c) for c in ("net_sales", "cogs", "gross_profit")]
    return _branch_days(spark, folder).join(branches, "branch_id", "left").select(F.col("day").cast("string").alias("day"), "branch_id", "branch_code", "governorate", *counts, *money, rate(F.col("fulfilled"), F.col("requested")).alias("fill_rate"))


_SUPPLY = """po AS (SELECT payload->>'$.purchase_order_id' AS order_id, payload->>'$.supplier_id' AS supplier_id, branch_id, (moment AT TIME ZONE 'UTC')::DATE AS ordered_on, TRY_CAST(payload->>'$.expected_delivery_on' AS DATE) AS expected_on, moment, kafka_topic, kafka_partition, kafka_offset FROM ok WHERE event_type = 'purchase_order.created'),
orders AS (SELECT order_id, supplier_id, min(ordered_on) AS ordered_on, min(expected_on) AS expected_on FROM po WHERE order_id IS NOT NULL AND supplier_id IS NOT NULL GROUP BY 1, 2),
receipts AS (SELECT order_id, min(day) AS received_on, count(*) AS receipts FROM (SELECT payload->>'$.purchase_order_id' AS order_id, (moment AT TIME ZONE 'UTC')::DATE AS day FROM ok WHERE event_type = 'goods_receipt.received') WHERE order_id IS NOT NULL GROUP BY 1),
supply AS (SELECT supplier_id, count(*) AS purchase_orders, coalesce(sum(receipts), 0)::BIGINT AS goods_receipts, count(*) FILTER (received_on > expected_on) AS delayed_receipts, round(avg(greatest(received_on - ordered_on, 0)), 6) AS average_lead_days FROM orders LEFT JOIN receipts USING (order_id) GROUP BY 1)"""


def _supply(spark: SparkSession, folder: str) -> DataFrame:
    order, supplier = _field("purchase_order_id").alias("order_id"), _field("supplier_id").alias("supplier_id")
    orders = _payloads(spark, folder, "purchase_order.created").groupBy(order, supplier).agg(F.min("day").alias("ordered_on"), F.min(_field("expected_delivery_on").try_cast("date")).alias("expected_on")).dropna(subset=["order_id", "supplier_id"])
    receipts = _payloads(spark, folder, "goods_receipt.received").groupBy(order).agg(F.min("day").alias("received_on"), F.count(F.lit(1)).alias("receipts")).filter("order_id IS NOT NULL")
    days = F.greatest(F.datediff("received_on", "ordered_on"), F.lit(0))
    return orders.join(receipts, "order_id", "left").groupBy("supplier_id").agg(F.count(F.lit(1)).alias("purchase_orders"), F.coalesce(F.sum("receipts"), _zero()).alias("goods_receipts"), F.count_if(F.col("received_on") > F.col("expected_on")).alias("delayed_receipts"), F.round(F.avg(days), 6).alias("average_lead_days"))


@query(f"WITH {_EVENTS}, {_SUPPLY} SELECT * FROM supply")
def mart7h_supplier_performance(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, receipts, delays and the days from order to first receipt of each supplier."""
    return _supply(spark, folder)


@query("SELECT branch_id, coalesce(nullif(trim(branch_code), ''), 'UNKNOWN') AS branch_code, display_name, governorate_code, governorate, locality_type, is_24_hours FROM pharmacy_branch WHERE branch_id IS NOT NULL")
def dim_branch(spark: SparkSession, folder: str) -> DataFrame:
    """Branches by their key."""
    code = F.coalesce(F.nullif(F.trim("branch_code"), F.lit("")), F.lit("UNKNOWN"))
    return table(spark, folder, "pharmacy_branch").filter("branch_id IS NOT NULL").select("branch_id", code.alias("branch_code"), "display_name", "governorate_code", "governorate", "locality_type", "is_24_hours")


@query("""SELECT product_id, trade_name_en, scientific_name, manufacturer, drug_class, route, retail_price_egp, source_snapshot_label FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY loaded_at DESC NULLS LAST, source_snapshot_label DESC NULLS LAST, source_record_number DESC NULLS LAST) AS k FROM master_product WHERE product_id IS NOT NULL) WHERE k = 1""")
def dim_product(spark: SparkSession, folder: str) -> DataFrame:
    """The record of each product loaded last; a maximum, which merges on the map side."""
    kept = ["trade_name_en", "scientific_name", "manufacturer", "drug_class", "route", "retail_price_egp", "source_snapshot_label"]
    last = F.max_by(F.struct(*kept), F.struct("loaded_at", "source_snapshot_label", "source_record_number"))
    return table(spark, folder, "master_product").filter("product_id IS NOT NULL").groupBy("product_id").agg(last.alias("m")).select("product_id", *[F.col(f"m.{c}").alias(c) for c in kept])


@query(f"WITH {_EVENTS} SELECT payload->>'$.supplier_id' AS supplier_id, min((moment AT TIME ZONE 'UTC')::DATE)::VARCHAR AS first_day, max((moment AT TIME ZONE 'UTC')::DATE)::VARCHAR AS last_day FROM ok WHERE event_type IN ('purchase_order.created', 'goods_receipt.received') AND payload->>'$.supplier_id' IS NOT NULL GROUP BY 1")
def dim_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers that events name, with their first and last day; no table has more of them."""
    named = _payloads(spark, folder, "purchase_order.created").unionByName(_payloads(spark, folder, "goods_receipt.received"))
    return named.groupBy(_field("supplier_id").alias("supplier_id")).agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day")).filter("supplier_id IS NOT NULL")


_POSITION = f"""{_BALANCES}, pos_newest AS (SELECT branch_id, product_id, arg_max(closing_units, day) AS on_hand FROM closing GROUP BY 1, 2),
{_EVENTS}, {_REORDERS}, pos_reorder AS (SELECT branch_id, product_id, arg_max(struct_pack(p := reorder_point, t := target_stock_level), struct_pack(m := moment, a := kafka_topic, b := kafka_partition, c := kafka_offset)) AS r FROM ro WHERE reorder_point IS NOT NULL AND target_stock_level IS NOT NULL GROUP BY 1, 2),
position AS (SELECT branch_id, product_id, on_hand, r.p AS reorder_point, r.t AS target_stock_level FROM pos_newest LEFT JOIN pos_reorder USING (branch_id, product_id))"""


def _position(spark: SparkSession, folder: str) -> DataFrame:
    own = ["branch_id", "product_id"]
    newest = _closing(spark, folder).groupBy(*own).agg(F.max_by("closing_units", "day").alias("on_hand"))
    place = F.struct("moment", "kafka_topic", "kafka_partition", "kafka_offset")
    points = _reorders(spark, folder).dropna(subset=["reorder_point", "target_stock_level"]).groupBy(*own).agg(F.max_by(F.struct("reorder_point", "target_stock_level"), place).alias("r"))
    return newest.join(points, own, "left").select(*own, "on_hand", "r.reorder_point", "r.target_stock_level")


@query(f"""WITH {_POSITION}, names AS (SELECT product_id, min(trade_name_en) AS trade_name_en FROM master_product GROUP BY 1) SELECT p.branch_id, b.branch_code, b.governorate, p.product_id, n.trade_name_en, on_hand, reorder_point, target_stock_level, coalesce(on_hand <= reorder_point, false) AS below_reorder,
  CASE WHEN target_stock_level <> 0 THEN round(on_hand / target_stock_level, 6) END AS coverage FROM position AS p LEFT JOIN pharmacy_branch AS b ON p.branch_id = b.branch_id LEFT JOIN names AS n ON p.product_id = n.product_id""")
def bi_v8_inventory_position(spark: SparkSession, folder: str) -> DataFrame:
    """The newest balance of each pair beside its newest reorder point, with names."""
    branches = table(spark, folder, "pharmacy_branch").select("branch_id", "branch_code", "governorate")
    names = table(spark, folder, "master_product").groupBy("product_id").agg(F.min("trade_name_en").alias("trade_name_en"))
    joined = _position(spark, folder).join(branches, "branch_id", "left").join(names, "product_id", "left")
    coverage = F.when(F.col("target_stock_level") != 0, F.round(F.col("on_hand") / F.col("target_stock_level"), 6))
    return joined.select("branch_id", "branch_code", "governorate", "product_id", "trade_name_en", "on_hand", "reorder_point", "target_stock_level", F.coalesce(F.col("on_hand") <= F.col("reorder_point"), F.lit(False)).alias("below_reorder"), coverage.alias("coverage"))


@query(f"""WITH {_SALE}, {_BRANCH_DAYS}, {_POSITION}, {_SUPPLY}, a AS (SELECT sum(requested)::BIGINT AS requested_units, sum(fulfilled)::BIGINT AS fulfilled_units, sum(lost)::BIGINT AS lost_units, round(sum(fulfilled) / sum(requested), 6) AS fill_rate, sum(stockout_attempts)::BIGINT AS stockout_attempts, sum(transactions)::BIGINT AS sales_transactions,
  sum(units_sold)::BIGINT AS units_sold, sum(net_sales) AS net_sales, sum(cogs) AS cogs, sum(gross_profit) AS gross_profit, round(sum(gross_profit)::DOUBLE / sum(net_sales)::DOUBLE, 6) AS gross_margin FROM bd),
b AS (SELECT sum(on_hand)::BIGINT AS on_hand_units, count(*) FILTER (on_hand <= reorder_point) AS below_reorder_positions, count(*) FILTER (on_hand = 0) AS zero_stock_positions FROM position),
c AS (SELECT sum(purchase_orders)::BIGINT AS purchase_orders, CASE WHEN sum(goods_receipts) > 0 THEN round(sum(delayed_receipts) / sum(goods_receipts), 6) END AS delayed_receipt_rate, round(avg(average_lead_days), 5) AS average_lead_days FROM supply) SELECT * FROM a, b, c""")
def bi_m_operations_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Production measures over the marts as one row: sums, ratios, filtered counts, averages."""
    sums = lambda names: [F.sum(c).alias(n) for n, c in names.items()]
    days = _branch_days(spark, folder).agg(*sums({"requested_units": "requested", "fulfilled_units": "fulfilled", "lost_units": "lost", "stockout_attempts": "stockout_attempts", "sales_transactions": "transactions", "units_sold": "units_sold", "net_sales": "net_sales", "cogs": "cogs", "gross_profit": "gross_profit"}))
    days = days.withColumns({"fill_rate": rate(F.col("fulfilled_units"), F.col("requested_units")), "gross_margin": rate(F.col("gross_profit"), F.col("net_sales"))})
    stock = _position(spark, folder).agg(F.sum("on_hand").alias("on_hand_units"), F.count_if(F.col("on_hand") <= F.col("reorder_point")).alias("below_reorder_positions"), F.count_if(F.col("on_hand") == 0).alias("zero_stock_positions"))
    supply = _supply(spark, folder).agg(F.sum("purchase_orders").alias("purchase_orders"), rate(F.sum("delayed_receipts"), F.sum("goods_receipts")).alias("delayed_receipt_rate"), F.round(F.avg("average_lead_days"), 5).alias("average_lead_days"))
    return days.join(stock).join(supply)  # one row each


@query(f"""WITH {_EVENTS}, {_SOLD_DAYS}, {_MOVED_DAYS}, {_REORDERS}, a AS (SELECT sum(requested)::BIGINT AS requested_units, sum(fulfilled)::BIGINT AS fulfilled_units, sum(lost)::BIGINT AS lost_units, round(sum(fulfilled) / sum(requested), 6) AS fulfillment_rate, sum(demand_lines)::BIGINT AS demand_lines, count(DISTINCT branch_id) AS active_branches, count(DISTINCT product_id) AS products_with_demand FROM sd),
b AS (SELECT sum(units_in)::BIGINT AS units_in, sum(units_out)::BIGINT AS units_out, sum(units_in - units_out)::BIGINT AS net_change FROM mv), c AS (SELECT count(*) AS reorder_events, sum(recommended)::BIGINT AS recommended_units FROM ro),
d AS (SELECT count(DISTINCT payload->>'$.purchase_order_id') AS purchase_orders, sum(TRY_CAST(payload->>'$.ordered_units' AS BIGINT))::BIGINT AS ordered_units FROM ok WHERE event_type = 'purchase_order.created'), e AS (SELECT sum(TRY_CAST(payload->>'$.received_units' AS BIGINT))::BIGINT AS received_units FROM ok WHERE event_type = 'goods_receipt.received'),
f AS (SELECT sum(TRY_CAST(payload->>'$.quantity' AS BIGINT))::BIGINT AS restocked_units FROM ok WHERE event_type = 'restock.applied') SELECT *, CASE WHEN ordered_units > 0 THEN round(received_units / ordered_units, 6) END AS procurement_fill_rate FROM a, b, c, d, e, f""")
def bi_m_event_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Measures over the facts made of events, as one row."""
    sold = _sold_days(spark, folder).agg(F.sum("requested").alias("requested_units"), F.sum("fulfilled").alias("fulfilled_units"), F.sum("lost").alias("lost_units"), F.sum("demand_lines").alias("demand_lines"), F.count_distinct("branch_id").alias("active_branches"), F.count_distinct("product_id").alias("products_with_demand"))
    moved = _moved_days(spark, folder).agg(F.sum("units_in").alias("units_in"), F.sum("units_out").alias("units_out"), F.sum(F.col("units_in") - F.col("units_out")).alias("net_change"))
    asked = _reorders(spark, folder).agg(F.count(F.lit(1)).alias("reorder_events"), F.sum("recommended").alias("recommended_units"))
    orders = _payloads(spark, folder, "purchase_order.created").agg(F.count_distinct(_field("purchase_order_id")).alias("purchase_orders"), _sum("ordered_units").alias("ordered_units"))
    received = _payloads(spark, folder, "goods_receipt.received").agg(_sum("received_units").alias("received_units"))
    restocked = _payloads(spark, folder, "restock.applied").agg(_sum("quantity").alias("restocked_units"))
    joined = sold.join(moved).join(asked).join(orders).join(received).join(restocked)  # one row each
    return joined.withColumns({"fulfillment_rate": rate(F.col("fulfilled_units"), F.col("requested_units")), "procurement_fill_rate": rate(F.col("received_units"), F.col("ordered_units"))})


_MEASURED = {
    "sale_header": "h.n", "sale_line": "l.n", "payment": "h.n", "demand_attempt": "d.n", "partial_demand_attempts": "d.partial", "stockout_demand_attempts": "d.stockouts", "lost_demand_units": "d.lost", "branches": "b.n", "governorates": "b.governorates", "channels": "h.channels",
    "known_transactions": "h.numbered", "terminals": "h.terminals", "products_sold": "l.products", "products": "p.n", "makers": "p.makers", "price_observations": "o.n", "priced_products": "o.products", "events": "e.n", "event_types": "e.types", "topics": "e.topics", "batches": "e.batches", "runs": "r.n", "finished_runs": "r.finished",
    "sale_movements": "e.moves", "purchase_orders": "e.orders", "goods_receipts": "e.receipts", "restocks": "e.restocks", "reorders": "e.reorders", "lines_without_product": "l.without_product", "sales_without_branch": "h.without_branch", "gross_sales_egp": "l.gross", "net_sales_egp": "l.net", "cogs_egp": "l.cogs", "gross_profit_egp": "l.profit", "discounts_egp": "l.discounts",
    "avg_lines_per_sale": "round(l.n / nullif(h.n, 0), 6)", "fill_rate": "round(d.fulfilled / nullif(d.requested, 0), 6)", "margin": "round(l.profit / nullif(l.net, 0), 6)",
}


@query("""WITH h AS (SELECT count(*) AS n, count(DISTINCT channel) AS channels, count(transaction_number) AS numbered, count(DISTINCT terminal_id) AS terminals, count(*) - count(branch_id) AS without_branch FROM sale_header),
l AS (SELECT count(*) AS n, count(DISTINCT product_id) AS products, count(*) - count(product_id) AS without_product, sum(gross_sales_egp)::DOUBLE AS gross, sum(net_sales_egp)::DOUBLE AS net, sum(cogs_egp)::DOUBLE AS cogs, sum(gross_profit_egp)::DOUBLE AS profit, sum(discount_amount_egp)::DOUBLE AS discounts FROM sale_line),
d AS (SELECT count(*) AS n, count(*) FILTER (fulfilled_units > 0 AND lost_units > 0) AS partial, count(*) FILTER (outcome = 'OUT_OF_STOCK') AS stockouts, sum(lost_units) AS lost, sum(requested_units) AS requested, sum(fulfilled_units) AS fulfilled FROM demand_attempt), b AS (SELECT count(*) AS n, count(DISTINCT governorate_code) AS governorates FROM pharmacy_branch),
p AS (SELECT count(*) AS n, count(DISTINCT manufacturer) AS makers FROM master_product), o AS (SELECT count(*) AS n, count(DISTINCT product_id) AS products FROM product_price_history), r AS (SELECT count(*) AS n, count(completed_at) AS finished FROM ingestion_run),
e AS (SELECT count(*) AS n, count(DISTINCT event_type) AS types, count(DISTINCT kafka_topic) AS topics, count(DISTINCT batch_id) AS batches, count(*) FILTER (event_type = 'inventory.quantity_changed') AS moves, count(*) FILTER (event_type = 'purchase_order.created') AS orders, count(*) FILTER (event_type = 'goods_receipt.received') AS receipts, count(*) FILTER (event_type = 'restock.applied') AS restocks, count(*) FILTER (event_type = 'inventory.reorder_required') AS reorders FROM bronze_event)
SELECT metric, round(value, 4) AS value FROM (""" + " UNION ALL ".join(f"SELECT '{name}' AS metric, ({made})::DOUBLE AS value FROM h, l, d, b, p, o, r, e" for name, made in _MEASURED.items()) + ")")
def q_metric_run_measures(spark: SparkSession, folder: str) -> DataFrame:
    """38 measures of all tables, each table read once, as rows of a name and a number."""
    n, one = F.count(F.lit(1)).alias("n"), F.count_distinct
    is_type = lambda kind: F.count_if(F.col("event_type") == kind)
    double = lambda c: F.sum(c).cast("double")
    tables = {
        "h": ("sale_header", [n, one("channel").alias("channels"), F.count("transaction_number").alias("numbered"), one("terminal_id").alias("terminals"), F.count_if(F.col("branch_id").isNull()).alias("without_branch")]),
        "l": ("sale_line", [n, one("product_id").alias("products"), F.count_if(F.col("product_id").isNull()).alias("without_product"), *[double(c).alias(a) for c, a in (("gross_sales_egp", "gross"), ("net_sales_egp", "net"), ("cogs_egp", "cogs"), ("gross_profit_egp", "profit"), ("discount_amount_egp", "discounts"))]]),
        "d": ("demand_attempt", [n, F.count_if((F.col("fulfilled_units") > 0) & (F.col("lost_units") > 0)).alias("partial"), F.count_if(F.col("outcome") == "OUT_OF_STOCK").alias("stockouts"), F.sum("lost_units").alias("lost"), F.sum("requested_units").alias("requested"), F.sum("fulfilled_units").alias("fulfilled")]),
        "b": ("pharmacy_branch", [n, one("governorate_code").alias("governorates")]), "p": ("master_product", [n, one("manufacturer").alias("makers")]), "o": ("product_price_history", [n, one("product_id").alias("products")]), "r": ("ingestion_run", [n, F.count("completed_at").alias("finished")]),
        "e": ("bronze_event", [n, one("event_type").alias("types"), one("kafka_topic").alias("topics"), one("batch_id").alias("batches"), is_type("inventory.quantity_changed").alias("moves"), is_type("purchase_order.created").alias("orders"), is_type("goods_receipt.received").alias("receipts"), is_type("restock.applied").alias("restocks"), is_type("inventory.reorder_required").alias("reorders")]),
    }
    wide = None
    for name, (source, figures) in tables.items():
        row = table(spark, folder, source).agg(*figures).select(F.struct("*").alias(name))
        wide = row if wide is None else wide.join(row)  # one row each
    measured = wide.select(*[F.round(F.expr(made).cast("double"), 4).alias(name) for name, made in _MEASURED.items()])
    return measured.unpivot([], list(_MEASURED), "metric", "value")


def singular_tests(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Queries that should find nothing: bounds, arithmetic, references and grains of facts, marts and stagings."""
    sales, moves, orders = fct_daily_sales_demand(spark, folder), fct_daily_inventory_movement(spark, folder), jn_19_order_lifecycle(spark, folder)
    reorders, sold = _reorders(spark, folder), _sold_days(spark, folder)
    branch_days, product_days = mart_branch_daily_operations(spark, folder), mart_product_daily_performance(spark, folder)
    operations, demand = mart7h_branch_daily_operations(spark, folder), mart_product_daily_demand(spark, folder)
    products, branches = table(spark, folder, "master_product").select("product_id").distinct(), dim_branch(spark, folder)
    attempts, lines = table(spark, folder, "demand_attempt"), table(spark, folder, "sale_line")
    suppliers = _payloads(spark, folder, "goods_receipt.received").select(_field("supplier_id").alias("supplier_id"))
    ordered = _payloads(spark, folder, "purchase_order.created").select(_field("supplier_id").alias("supplier_id")).distinct()
    return {
        "branches_have_governorates": branches.filter("governorate_code IS NULL"),
        "observed_balances": moves.filter("opening < 0 OR closing < 0 OR movements < 1"),
        "moved_products_known": quality.orphans(moves, "product_id", products, "product_id"),
        "operating_branches_known": quality.orphans(branch_days, "branch_id", branches, "branch_id"),
        "orders_without_money": _payloads(spark, folder, "purchase_order.created").filter(F.lower(_field("monetary_values_generated")) == "true"),
        "receiving_suppliers_ordered": quality.orphans(suppliers, "supplier_id", ordered, "supplier_id"),
        "order_units_bounded": orders.filter("ordered_units < 0 OR received_units < 0 OR restocked_units < 0"),
        "reorder_quantities_nonnegative": reorders.filter("available_quantity < 0 OR reorder_point < 0 OR target_stock_level < 0 OR recommended < 0"),
        "sold_products_known": quality.orphans(sales, "product_id", products, "product_id"),
        "sale_units_add_up": sold.filter("requested <> fulfilled + lost OR requested < 0 OR fulfilled < 0 OR lost < 0"),
        "branch_fill_rate_bounded": operations.filter("fill_rate < 0 OR fill_rate > 1"),
        "demand_reconciles": attempts.filter("requested_units <> fulfilled_units + lost_units"),
        "stock_nonnegative": _position(spark, folder).filter("on_hand < 0"),
        "profit_adds_up": lines.filter("abs(net_sales_egp - cogs_egp - gross_profit_egp) > 0.01"),
        "operations_grain": quality.repeated_keys(operations, ["day", "branch_id"]),
        "product_days_grain": quality.repeated_keys(product_days, ["day", "product_id"]),
        "branch_days_grain": quality.repeated_keys(branch_days, ["day", "branch_id"]),
        "inventory_days_grain": quality.repeated_keys(moves, ["day", "branch_id", "product_id"]),
        "sale_days_grain": quality.repeated_keys(sales, ["day", "branch_id", "product_id", "channel"]),
        "demand_days_grain": quality.repeated_keys(demand, ["day", "product_id"]),
    }


def _found(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS check_name, count(*) AS rows_found, count(*) = 0 AS passed FROM ({sql})"


_NO_ROWS = "SELECT 1 WHERE false"
_GRAINS = ["operations_grain", "product_days_grain", "branch_days_grain", "inventory_days_grain", "sale_days_grain", "demand_days_grain"]
_UNKNOWN = "SELECT DISTINCT {0} FROM {1} WHERE {0} IS NOT NULL EXCEPT SELECT {0} FROM {2}"
_SINGULAR = {
    "branches_have_governorates": "SELECT 1 FROM pharmacy_branch WHERE branch_id IS NOT NULL AND governorate_code IS NULL",
    "observed_balances": """SELECT 1 FROM (SELECT arg_min(TRY_CAST(payload->>'$.on_hand_before' AS BIGINT), p) AS o, arg_max(TRY_CAST(payload->>'$.on_hand_after' AS BIGINT), p) AS c FROM (SELECT *, struct_pack(a := moment, b := kafka_topic, c := kafka_partition, d := kafka_offset) AS p FROM ok WHERE event_type = 'inventory.quantity_changed' AND moment IS NOT NULL)
  GROUP BY (moment AT TIME ZONE 'UTC')::DATE, branch_id, product_id) WHERE o < 0 OR c < 0""",
    "moved_products_known": _UNKNOWN.format("product_id", "mv", "master_product"),
    "operating_branches_known": "SELECT branch_id FROM (SELECT branch_id FROM sd UNION SELECT branch_id FROM mv UNION SELECT branch_id FROM ro) WHERE branch_id IS NOT NULL EXCEPT SELECT branch_id FROM pharmacy_branch",
    "orders_without_money": "SELECT 1 FROM ok WHERE event_type = 'purchase_order.created' AND lower(payload->>'$.monetary_values_generated') = 'true'",
    "receiving_suppliers_ordered": "SELECT payload->>'$.supplier_id' AS s FROM ok WHERE event_type = 'goods_receipt.received' AND s IS NOT NULL EXCEPT SELECT payload->>'$.supplier_id' FROM ok WHERE event_type = 'purchase_order.created'",
    "order_units_bounded": """SELECT o.k FROM (SELECT payload->>'$.purchase_order_id' AS k, max(TRY_CAST(payload->>'$.ordered_units' AS BIGINT)) AS u FROM ok WHERE event_type = 'purchase_order.created' AND k IS NOT NULL GROUP BY 1) AS o
  LEFT JOIN (SELECT payload->>'$.purchase_order_id' AS k, sum(TRY_CAST(payload->>'$.received_units' AS BIGINT)) AS u FROM ok WHERE event_type = 'goods_receipt.received' GROUP BY 1) AS r USING (k) LEFT JOIN (SELECT payload->>'$.purchase_order_id' AS k, sum(TRY_CAST(payload->>'$.quantity' AS BIGINT)) AS u FROM ok WHERE event_type = 'restock.applied' GROUP BY 1) AS s USING (k) WHERE o.u < 0 OR r.u < 0 OR s.u < 0""",
    "reorder_quantities_nonnegative": "SELECT 1 FROM ro WHERE available_quantity < 0 OR reorder_point < 0 OR target_stock_level < 0 OR recommended < 0",
    "sold_products_known": _UNKNOWN.format("product_id", "sd", "master_product"),
    "sale_units_add_up": "SELECT day, branch_id, product_id FROM sd GROUP BY 1, 2, 3 HAVING sum(requested) <> sum(fulfilled) + sum(lost) OR sum(requested) < 0 OR sum(fulfilled) < 0 OR sum(lost) < 0",
    "branch_fill_rate_bounded": "SELECT 1 FROM bd WHERE requested > 0 AND (round(fulfilled / requested, 6) < 0 OR round(fulfilled / requested, 6) > 1)",
    "demand_reconciles": "SELECT 1 FROM demand_attempt WHERE requested_units <> fulfilled_units + lost_units",
    "stock_nonnegative": "SELECT 1 FROM pos_newest WHERE on_hand < 0",
    "profit_adds_up": "SELECT 1 FROM sale_line WHERE abs(net_sales_egp - cogs_egp - gross_profit_egp) > 0.01",
} | dict.fromkeys(_GRAINS, _NO_ROWS)


@query(f"WITH {_SALE}, {_BRANCH_DAYS}, {_POSITION}, {_SOLD_DAYS}, {_MOVED_DAYS} " + " UNION ALL ".join(_found(n, s) for n, s in _SINGULAR.items()))
def dq_01_singular_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty queries that should find nothing, with what they found."""
    return quality.report(singular_tests(spark, folder))


#: Least rows of a table at this scale, as a share of the rows of the table of sales.
_LEAST = {"sale_header": 1.0, "sale_line": 2.0, "demand_attempt": 0.9, "bronze_event": 0.5, "master_product": 0.05, "ingestion_run": 0.01, "pharmacy_branch": 0.0, "product_price_history": 0.0}


@query("WITH s AS (SELECT count(*) AS n FROM sale_header) " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS rows, greatest(1, ceil(n * {share}))::BIGINT AS least_rows, (SELECT count(*) FROM {t}) >= greatest(1, ceil(n * {share})) AS enough FROM s" for t, share in _LEAST.items()))
def dq_07_minimum_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each table against the least that it must have."""
    sales = table(spark, folder, "sale_header").agg(F.count(F.lit(1)).alias("sales"))  # one row
    counted = {t: table(spark, folder, t).agg(F.count(F.lit(1)).alias("rows")) for t in _LEAST}
    return quality.minimum_rows(counted, {t: lambda share=share: F.greatest(F.lit(1), F.ceil(F.col("sales") * share)) for t, share in _LEAST.items()}, sales)


_HEALTH = {
    "tables_with_rows": ("SELECT count(*) FROM (" + " UNION ALL ".join(f"SELECT 1 FROM (SELECT count(*) AS n FROM {t}) WHERE n > 0" for t in _LEAST) + ")", "= 8"),
    "baseline_rows": ("SELECT count(*) FROM sale_line", ">= (SELECT count(*) FROM sale_header)"),
    "views": ("SELECT 5", "= 5"),
    "marts_with_rows": ("SELECT count(*) FROM (SELECT 1 FROM (SELECT count(*) AS n FROM bd) WHERE n > 0 UNION ALL SELECT 1 FROM (SELECT count(*) AS n FROM sd) WHERE n > 0 UNION ALL SELECT 1 FROM (SELECT count(*) AS n FROM supply) WHERE n > 0)", "= 3"),
    "repeated_event_rows": ("SELECT count(event_id) - count(DISTINCT event_id) FROM bronze_event", "= 0"),
    "readable_events": ("SELECT count(DISTINCT event_id) FROM bronze_event", ">= 1"),
    "last_run_finished": ("SELECT count(*) FROM (SELECT completed_at FROM ingestion_run WHERE started_at IS NOT NULL ORDER BY started_at DESC, run_id DESC LIMIT 1) WHERE completed_at IS NOT NULL", "= 1"),
    "payload_bytes": ("SELECT coalesce(sum(strlen(payload)), 0) FROM bronze_event", "< 8500000000"),
}


@query(f"WITH {_SALE}, {_BRANCH_DAYS}, {_EVENTS}, {_SOLD_DAYS}, {_SUPPLY} " + " UNION ALL ".join(f"SELECT '{n}' AS check_name, ({s})::BIGINT AS observed, (({s}) {test}) AS passed" for n, (s, test) in _HEALTH.items()))
def dq_04_health_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Eight checks of the whole warehouse with what was observed: tables, baseline, views, marts, repeats, readability, last run, storage."""
    events, runs = table(spark, folder, "bronze_event"), table(spark, folder, "ingestion_run")
    number = lambda frame, observed: frame.agg(observed.cast("long").alias("observed"))
    some = lambda frames: _united([f.agg((F.count(F.lit(1)) > 0).cast("long").alias("some")) for f in frames]).agg(F.sum("some").alias("observed"))
    last = F.max(F.struct("started_at", "run_id", F.col("completed_at").isNotNull().cast("long").alias("done")))
    sales = table(spark, folder, "sale_header").agg(F.count(F.lit(1)).alias("sales"))
    checks = [
        ("tables_with_rows", some([table(spark, folder, t) for t in _LEAST]), F.col("observed") == len(_LEAST)),
        ("baseline_rows", number(table(spark, folder, "sale_line"), F.count(F.lit(1))).join(sales), F.col("observed") >= F.col("sales")),
        ("views", spark.range(1).select(F.lit(len(STAR)).cast("long").alias("observed")), F.col("observed") == 5),
        ("marts_with_rows", some([_branch_days(spark, folder), _sold_days(spark, folder), _supply(spark, folder)]), F.col("observed") == 3),
        ("repeated_event_rows", number(events, F.count("event_id") - F.count_distinct("event_id")), F.col("observed") == 0),
        ("readable_events", number(events, F.count_distinct("event_id")), F.col("observed") >= 1),
        ("last_run_finished", number(runs.filter("started_at IS NOT NULL"), F.coalesce(last["done"], F.lit(0))), F.col("observed") == 1),
        ("payload_bytes", number(events, F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))), F.col("observed") < 8_500_000_000),
    ]
    return _united([row.select(F.lit(name).alias("check_name"), "observed", passed.alias("passed")) for name, row, passed in checks])


def _united(parts: list[DataFrame]) -> DataFrame:
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


#: Columns of a master snapshot by table: key, and what must not be blank.
_MASTERS = {"master_product": ("product_id", ["trade_name_en"]), "pharmacy_branch": ("branch_id", ["branch_code", "display_name"])}
#: Parts of column names that a master without prices must not have.
MONETARY = ("price", "cost", "amount", "egp", "revenue", "margin")


@query("""SELECT 'master_product' AS table_name, count(*) AS rows, count(*) FILTER (product_id IS NULL OR trim(product_id) = '') AS blank_keys, count(product_id) - count(DISTINCT product_id) AS repeated_keys, count(*) FILTER (trade_name_en IS NULL OR trim(trade_name_en) = '') AS blank_names, 0 AS unknown_branches, 'retail_price_egp' AS monetary_columns FROM master_product
UNION ALL SELECT 'pharmacy_branch', count(*), count(*) FILTER (branch_id IS NULL OR trim(branch_id) = ''), count(branch_id) - count(DISTINCT branch_id), count(*) FILTER (branch_code IS NULL OR trim(branch_code) = '' OR display_name IS NULL OR trim(display_name) = ''), (SELECT count(DISTINCT branch_id) FROM sale_header WHERE branch_id IS NOT NULL AND branch_id NOT IN (SELECT branch_id FROM pharmacy_branch WHERE branch_id IS NOT NULL)), '' FROM pharmacy_branch""")
def alg_32_master_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Each master table with its rows, blank and repeated keys, blank names, branches it lacks, and its monetary columns."""
    parts = []
    for name, (key, named) in _MASTERS.items():
        rows = table(spark, folder, name)
        blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
        nameless = F.lit(False)
        for c in named:
            nameless = nameless | blank(c)
        lacking = quality.orphans(table(spark, folder, "sale_header"), "branch_id", rows, key).agg(F.count(F.lit(1)).alias("unknown_branches")) if key == "branch_id" else spark.range(1).select(_zero().alias("unknown_branches"))
        figures = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(blank(key)).alias("blank_keys"), (F.count(key) - F.count_distinct(key)).alias("repeated_keys"), F.count_if(nameless).alias("blank_names"))
        monetary = ", ".join(c for c in rows.columns if any(part in c for part in MONETARY))
        parts.append(figures.join(lacking).select(F.lit(name).alias("table_name"), "*", F.lit(monetary).alias("monetary_columns")))  # one row each
    return _united(parts)


@query("""SELECT 'branches' AS subject, count(*) AS rows, count(DISTINCT branch_id) AS distinct_keys, count(*) FILTER (governorate IS NULL OR trim(governorate) = '') AS incomplete, count(*) FILTER (checkout_points < 1 OR demand_index <= 0) AS out_of_range FROM pharmacy_branch
UNION ALL SELECT 'prices', count(*), count(DISTINCT price_observation_id), count(*) FILTER (price_egp IS NULL OR observed_at IS NULL), count(*) FILTER (price_egp <= 0) FROM product_price_history
UNION ALL SELECT 'lines', count(*), count(DISTINCT sale_line_id), count(*) FILTER (sale_id IS NULL OR product_id IS NULL), count(*) FILTER (quantity <= 0 OR discount_pct < 0 OR discount_pct > 1 OR net_sales_egp < 0) FROM sale_line""")
def dq_06_quality_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct keys, incomplete rows and rows out of range of the network, its prices and its lines."""
    checks = {
        "branches": ("pharmacy_branch", "branch_id", "governorate IS NULL OR trim(governorate) = ''", "checkout_points < 1 OR demand_index <= 0"),
        "prices": ("product_price_history", "price_observation_id", "price_egp IS NULL OR observed_at IS NULL", "price_egp <= 0"),
        "lines": ("sale_line", "sale_line_id", "sale_id IS NULL OR product_id IS NULL", "quantity <= 0 OR discount_pct < 0 OR discount_pct > 1 OR net_sales_egp < 0"),
    }
    return _united([table(spark, folder, name).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys"), F.count_if(F.expr(incomplete)).alias("incomplete"), F.count_if(F.expr(beyond)).alias("out_of_range")).select(F.lit(subject).alias("subject"), "*") for subject, (name, key, incomplete, beyond) in checks.items()])


#: The star's views: dimensions and facts, each with what makes it; the names that dashboards know them by go on top.
STAR = {"dim_branch": dim_branch, "dim_product": dim_product, "dim_supplier": dim_supplier, "fact_branch_daily_operations": mart7h_branch_daily_operations, "fact_supplier_performance": mart7h_supplier_performance}
#: Serving names and what they show.
ALIASES = {
    "serving_dim_branch": dim_branch, "serving_dim_product": dim_product, "serving_dim_supplier": dim_supplier, "serving_fact_sales_demand": fct_daily_sales_demand, "serving_fact_inventory_movement": fct_daily_inventory_movement, "serving_fact_reorder_events": fct_reorder_events,
    "serving_fact_procurement_order_lifecycle": jn_19_order_lifecycle, "serving_mart_branch_daily_operations": mart_branch_daily_operations, "serving_mart_product_daily_demand": mart_product_daily_demand, "serving_mart_supplier_performance": mart7h_supplier_performance,
}


def register_serving(spark: SparkSession, folder: str, prefix: str = "bi") -> list[str]:
    """The serving names as temporary views; nothing is copied, each is made when it is asked."""
    for name, made in ALIASES.items():
        made(spark, folder).createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in ALIASES]


@query(f"""WITH {_EVENTS}, {_SOLD_DAYS}, {_MOVED_DAYS}, {_REORDERS}, {_SUPPLY}, k AS (SELECT day, branch_id FROM sd UNION SELECT day, branch_id FROM mv UNION SELECT day, branch_id FROM ro)
SELECT 'serving_dim_branch' AS view_name, (SELECT count(*) FROM pharmacy_branch WHERE branch_id IS NOT NULL) AS rows UNION ALL SELECT 'serving_dim_product', count(DISTINCT product_id) FROM master_product UNION ALL SELECT 'serving_dim_supplier', count(DISTINCT payload->>'$.supplier_id') FROM ok WHERE event_type IN ('purchase_order.created', 'goods_receipt.received')
UNION ALL SELECT 'serving_fact_sales_demand', count(*) FROM sd UNION ALL SELECT 'serving_fact_inventory_movement', count(*) FROM mv UNION ALL SELECT 'serving_fact_reorder_events', count(*) FROM ro UNION ALL SELECT 'serving_fact_procurement_order_lifecycle', count(DISTINCT payload->>'$.purchase_order_id') FROM ok WHERE event_type = 'purchase_order.created'
UNION ALL SELECT 'serving_mart_branch_daily_operations', count(*) FROM k WHERE branch_id IS NOT NULL UNION ALL SELECT 'serving_mart_product_daily_demand', count(*) FROM (SELECT DISTINCT day, product_id FROM sd) UNION ALL SELECT 'serving_mart_supplier_performance', count(*) FROM supply""")
def bi_v10_serving_views(spark: SparkSession, folder: str) -> DataFrame:
    """The serving views with their rows, asked through SQL."""
    prefix = f"bi_{uuid.uuid4().hex[:12]}"
    register_serving(spark, folder, prefix)
    counted = _united([spark.sql(f"SELECT '{name}' AS view_name, count(*) AS rows FROM {prefix}_{name}") for name in ALIASES])
    for name in ALIASES:  # they are resolved by now
        spark.catalog.dropTempView(f"{prefix}_{name}")
    return counted
