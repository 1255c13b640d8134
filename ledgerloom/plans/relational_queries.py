"""Joins, aggregates, windows, sorts and set operations on the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import hash_unit
from ..functions.numbers import rate
from ..functions.temporal import utc_day
from ..operators.ranking import ranked, tile
from ..operators.running import along
from ..registry import query
from ..session import table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sale_line")


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sale_header")


_NAMES = "names AS (SELECT product_id, min(trade_name_en) AS trade_name_en, min(drug_class) AS drug_class FROM master_product GROUP BY 1)"
_ONE_SALE = "sales AS (SELECT sale_id, min(branch_id) AS branch_id, min(transaction_ts) AS transaction_ts FROM sale_header WHERE sale_id IS NOT NULL GROUP BY 1)"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "master_product").groupBy("product_id").agg(F.min("trade_name_en").alias("trade_name_en"), F.min("drug_class").alias("drug_class"))


def _one_sale(spark: SparkSession, folder: str) -> DataFrame:
    return _sales(spark, folder).filter("sale_id IS NOT NULL").groupBy("sale_id").agg(F.min("branch_id").alias("branch_id"), F.min("transaction_ts").alias("transaction_ts"))


@query(f"""WITH {_NAMES}, {_ONE_SALE} SELECT b.governorate, n.drug_class, count(*) AS lines, sum(l.quantity)::BIGINT AS units, sum(l.net_sales_egp) AS net_sales FROM sale_line AS l
JOIN sales AS s ON l.sale_id = s.sale_id JOIN pharmacy_branch AS b ON s.branch_id = b.branch_id JOIN names AS n ON l.product_id = n.product_id GROUP BY 1, 2""")
def jn_01_star_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their sale, branch and product, summed by governorate and class. Dimensions are broadcast where AQE finds
    them small; lines are folded by sale and product only after the join that needs them."""
    branches = table(spark, folder, "pharmacy_branch").select("branch_id", "governorate")
    joined = _lines(spark, folder).select("sale_id", "product_id", "quantity", "net_sales_egp").join(_one_sale(spark, folder), "sale_id").join(branches, "branch_id").join(_names(spark, folder), "product_id")
    return joined.groupBy("governorate", "drug_class").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.sum("net_sales_egp").alias("net_sales"))


@query("""SELECT p.product_id, p.source_system FROM (SELECT product_id, min(source_system) AS source_system FROM master_product GROUP BY 1) AS p LEFT JOIN (SELECT DISTINCT product_id FROM sale_line) AS l ON p.product_id = l.product_id WHERE l.product_id IS NULL""")
def jn_04_unsold_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products without a line: an anti join, with the lines' products distinct first."""
    sold = _lines(spark, folder).select("product_id").filter("product_id IS NOT NULL").distinct()
    return table(spark, folder, "master_product").groupBy("product_id").agg(F.min("source_system").alias("source_system")).join(sold, "product_id", "left_anti")


@query("""SELECT h.sale_id, h.transaction_number, coalesce(b.governorate, 'UNKNOWN') AS governorate, coalesce(b.checkout_points, 1)::INT AS checkout_points FROM sale_header AS h LEFT JOIN pharmacy_branch AS b ON h.branch_id = b.branch_id""")
def jn_05_enrich_with_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Sales with their branch, or defaults where there is none."""
    branches = table(spark, folder, "pharmacy_branch").select("branch_id", "governorate", "checkout_points")
    return _sales(spark, folder).join(branches, "branch_id", "left").select("sale_id", "transaction_number", F.coalesce("governorate", F.lit("UNKNOWN")).alias("governorate"), F.coalesce("checkout_points", F.lit(1)).alias("checkout_points"))


@query("""WITH t AS (SELECT sum(net_sales_egp) AS whole FROM sale_header), b AS (SELECT branch_id, sum(net_sales_egp) AS net_sales FROM sale_header GROUP BY 1) SELECT branch_id, net_sales, round(net_sales::DOUBLE / whole::DOUBLE, 6) AS share FROM b, t""")
def jn_06_share_of_total(spark: SparkSession, folder: str) -> DataFrame:
    """Each branch's share of the whole: one broadcast row beside the groups."""
    sums = _sales(spark, folder).groupBy("branch_id").agg(F.sum("net_sales_egp").alias("net_sales"))
    whole = _sales(spark, folder).agg(F.sum("net_sales_egp").alias("whole"))
    return sums.join(F.broadcast(whole)).select("branch_id", "net_sales", F.round(F.col("net_sales").cast("double") / F.col("whole").cast("double"), 6).alias("share"))


@query("SELECT sale_line_id, quantity, unnest(generate_series(1, quantity))::INT AS unit_no FROM sale_line WHERE quantity >= 1")
def jn_08_unit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One row a unit sold; lines without a positive quantity give none."""
    return _lines(spark, folder).filter("quantity >= 1").select("sale_line_id", "quantity", F.explode(F.sequence(F.lit(1), "quantity")).alias("unit_no"))


@query(f"""WITH {_ONE_SALE}, ranked AS (SELECT branch_id, row_number() OVER (ORDER BY branch_code) AS seq, count(*) OVER () AS n FROM pharmacy_branch), hashed AS (SELECT sale_id, 1 + least(b.n - 1, floor(b.n * (('0x' || substr(md5(sale_id), 1, 8))::BIGINT / 4294967295.0)))::BIGINT AS seq FROM sales, (SELECT count(*) AS n FROM pharmacy_branch) AS b)
SELECT h.sale_id, r.branch_id AS drawn_branch_id FROM hashed AS h JOIN ranked AS r ON h.seq = r.seq""")
def jn_11_ordinal_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    """A branch drawn for each sale: a join of an ordinal computed from a hash with a rank."""
    # ranks without one task for all; the number of branches is one row
    branches = ranked(table(spark, folder, "pharmacy_branch").select("branch_id", "branch_code"), "branch_code", "branch_id").select("branch_id", F.col("rank").alias("seq"))
    number = table(spark, folder, "pharmacy_branch").agg(F.count(F.lit(1)).alias("n"))
    drawn = _one_sale(spark, folder).join(F.broadcast(number)).select("sale_id", (1 + F.least(F.col("n") - 1, F.floor(F.col("n") * hash_unit(F.col("sale_id"))))).alias("seq"))
    return drawn.join(branches, "seq").select("sale_id", F.col("branch_id").alias("drawn_branch_id"))


@query("""WITH d AS (SELECT branch_id, (transaction_ts AT TIME ZONE 'UTC')::DATE AS day, count(*) AS attempts, sum(requested_units)::BIGINT AS requested FROM demand_attempt WHERE branch_id IS NOT NULL AND transaction_ts IS NOT NULL GROUP BY 1, 2),
s AS (SELECT branch_id, (transaction_ts AT TIME ZONE 'UTC')::DATE AS day, count(*) AS sales, sum(net_sales_egp) AS net_sales FROM sale_header WHERE branch_id IS NOT NULL AND transaction_ts IS NOT NULL GROUP BY 1, 2)
SELECT branch_id, day::VARCHAR AS day, attempts, requested, sales, net_sales FROM d JOIN s USING (branch_id, day)""")
def jn_12_demand_and_sales_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Demand and sales of each branch and day, each side folded before the join."""
    own = ["branch_id", "day"]
    daily = lambda rows: rows.filter("branch_id IS NOT NULL AND transaction_ts IS NOT NULL").groupBy("branch_id", utc_day("transaction_ts").alias("day"))
    demand = daily(table(spark, folder, "demand_attempt")).agg(F.count(F.lit(1)).alias("attempts"), F.sum("requested_units").alias("requested"))
    sales = daily(_sales(spark, folder)).agg(F.count(F.lit(1)).alias("sales"), F.sum("net_sales_egp").alias("net_sales"))
    return demand.join(sales, own).withColumn("day", F.col("day").cast("string"))


@query("""WITH a AS (SELECT max(transaction_ts) AS as_of FROM sale_header) SELECT branch_id, count(*) AS sales, sum(net_sales_egp) AS net_sales FROM sale_header, a WHERE transaction_ts BETWEEN as_of - INTERVAL 30 DAY AND as_of GROUP BY 1""")
def jn_14_range_of_last_month(spark: SparkSession, folder: str) -> DataFrame:
    """Sales of the 30 days up to the last: a range join with one row."""
    last = _sales(spark, folder).agg(F.max("transaction_ts").alias("as_of"))
    within = F.col("transaction_ts").between(F.col("as_of") - F.expr("INTERVAL 30 DAYS"), F.col("as_of"))
    return _sales(spark, folder).join(F.broadcast(last), within).groupBy("branch_id").agg(F.count(F.lit(1)).alias("sales"), F.sum("net_sales_egp").alias("net_sales"))


_ORDERS = """orders_seen AS (SELECT payload->>'$.branch_id' AS branch_id, payload->>'$.supplier_id' AS supplier_id, kafka_timestamp, kafka_topic, kafka_partition, kafka_offset FROM (SELECT * FROM bronze_event WHERE event_type = 'purchase_order.created' AND json_valid(payload)))"""


@query(f"""WITH {_ORDERS} SELECT branch_id, supplier_id, orders FROM (SELECT *, count(*) OVER (PARTITION BY branch_id) AS orders, row_number() OVER (PARTITION BY branch_id ORDER BY kafka_timestamp DESC, kafka_topic DESC, kafka_partition DESC, kafka_offset DESC) AS k FROM orders_seen WHERE branch_id IS NOT NULL) WHERE k = 1""")
def jn_15_latest_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """The supplier of each branch's newest order; places break ties."""
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    seen = table(spark, folder, "bronze_event").filter("event_type = 'purchase_order.created'").select(field("branch_id").alias("branch_id"), field("supplier_id").alias("supplier_id"), "kafka_timestamp", "kafka_topic", "kafka_partition", "kafka_offset").filter("branch_id IS NOT NULL")
    newest = F.max(F.struct("kafka_timestamp", "kafka_topic", "kafka_partition", "kafka_offset", "supplier_id")).alias("m")
    return seen.groupBy("branch_id").agg(newest, F.count(F.lit(1)).alias("orders")).select("branch_id", "m.supplier_id", "orders")


@query("""SELECT DISTINCT product_id FROM demand_attempt AS d WHERE EXISTS (SELECT 1 FROM sale_line AS l WHERE l.product_id = d.product_id) AND EXISTS (SELECT 1 FROM product_price_history AS p WHERE p.product_id = d.product_id AND p.official_price_verified)""")
def jn_18_products_with_both(spark: SparkSession, folder: str) -> DataFrame:
    """Products asked for that were sold and have a verified price: semi joins of distinct keys."""
    asked = table(spark, folder, "demand_attempt").select("product_id").distinct()
    sold = _lines(spark, folder).select("product_id").distinct()
    priced = table(spark, folder, "product_price_history").filter("official_price_verified").select("product_id")
    return asked.join(sold, "product_id", "left_semi").join(priced, "product_id", "left_semi")


_CHAIN = """po AS (SELECT payload->>'$.purchase_order_id' AS purchase_order_id, min(payload->>'$.supplier_id') AS supplier_id, max(TRY_CAST(payload->>'$.ordered_units' AS BIGINT)) AS ordered_units FROM ok WHERE event_type = 'purchase_order.created' GROUP BY 1),
gr AS (SELECT payload->>'$.purchase_order_id' AS purchase_order_id, count(*) AS receipts, sum(TRY_CAST(payload->>'$.received_units' AS BIGINT))::BIGINT AS received_units FROM ok WHERE event_type = 'goods_receipt.received' GROUP BY 1),
rs AS (SELECT payload->>'$.purchase_order_id' AS purchase_order_id, sum(TRY_CAST(payload->>'$.quantity' AS BIGINT))::BIGINT AS restocked_units FROM ok WHERE event_type = 'restock.applied' GROUP BY 1)"""


@query(f"""WITH ok AS (SELECT * FROM bronze_event WHERE json_valid(payload)), {_CHAIN} SELECT po.purchase_order_id, supplier_id, ordered_units, coalesce(receipts, 0) AS receipts, coalesce(received_units, 0) AS received_units, coalesce(restocked_units, 0) AS restocked_units,
  CASE WHEN ordered_units > 0 THEN round(coalesce(received_units, 0) / ordered_units, 6) END AS receipt_rate FROM po LEFT JOIN gr USING (purchase_order_id) LEFT JOIN rs USING (purchase_order_id) WHERE po.purchase_order_id IS NOT NULL""")
def jn_19_order_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with what was received and restocked (inferred mart): each side folded by order first, so nothing multiplies."""
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    units = lambda n: field(n).try_cast("long")
    events = table(spark, folder, "bronze_event").select("event_type", "payload").withColumn("purchase_order_id", field("purchase_order_id")).filter("purchase_order_id IS NOT NULL")
    of = lambda kind: events.filter(F.col("event_type") == kind).groupBy("purchase_order_id")
    orders = of("purchase_order.created").agg(F.min(field("supplier_id")).alias("supplier_id"), F.max(units("ordered_units")).alias("ordered_units"))
    receipts = of("goods_receipt.received").agg(F.count(F.lit(1)).alias("receipts"), F.sum(units("received_units")).alias("received_units"))
    restocks = of("restock.applied").agg(F.sum(units("quantity")).alias("restocked_units"))
    joined = orders.join(receipts, "purchase_order_id", "left").join(restocks, "purchase_order_id", "left").fillna(0, ["receipts", "received_units", "restocked_units"])
    return joined.withColumn("receipt_rate", rate(F.col("received_units"), F.col("ordered_units")))


@query("""SELECT sale_id, count(*) AS lines, sum(quantity)::BIGINT AS units, sum(gross_sales_egp) AS gross_sales, sum(discount_amount_egp) AS discounts, sum(net_sales_egp) AS net_sales, sum(gross_profit_egp) AS gross_profit,
  CASE WHEN sum(net_sales_egp) > 0 THEN round(sum(gross_profit_egp)::DOUBLE / sum(net_sales_egp)::DOUBLE, 6) END AS margin FROM sale_line WHERE sale_id IS NOT NULL GROUP BY 1""")
def ag_16_header_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines rolled up to their sale with its margin."""
    sums = _lines(spark, folder).filter("sale_id IS NOT NULL").groupBy("sale_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.sum("gross_sales_egp").alias("gross_sales"), F.sum("discount_amount_egp").alias("discounts"), F.sum("net_sales_egp").alias("net_sales"), F.sum("gross_profit_egp").alias("gross_profit"))
    return sums.withColumn("margin", rate(F.col("gross_profit"), F.col("net_sales")))


@query("""SELECT count(*) AS rows, count(DISTINCT product_id) AS products, count(*) FILTER (outcome = 'PARTIAL') AS partial_attempts, sum(CASE WHEN lost_units > 0 THEN 1 ELSE 0 END)::BIGINT AS losing_attempts, max(CASE WHEN outcome = 'OUT_OF_STOCK' THEN 1 ELSE 0 END)::INT AS any_stockout,
  round(avg(epoch_us(created_at) - epoch_us(transaction_ts)) / 86400e6, 6) AS average_delay_days, round(sum(lost_units) / greatest(sum(requested_units), 1), 6) AS lost_rate, bool_and(requested_units >= fulfilled_units) AS never_over, round(stddev_samp(requested_units), 6) AS deviation,
  min(transaction_ts)::VARCHAR IS NOT NULL AS has_first FROM demand_attempt""")
def ag_05_aggregates_in_one_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Filtered counts, conditional sums, flags, averages of durations, safe ratios, deviation: one scan, one row."""
    delay = (F.unix_micros("created_at") - F.unix_micros("transaction_ts"))
    return table(spark, folder, "demand_attempt").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("product_id").alias("products"), F.count_if(F.col("outcome") == "PARTIAL").alias("partial_attempts"), F.sum(F.when(F.col("lost_units") > 0, 1).otherwise(0)).alias("losing_attempts"), F.max(F.when(F.col("outcome") == "OUT_OF_STOCK", 1).otherwise(0)).alias("any_stockout"),
        F.round(F.avg(delay) / 86400e6, 6).alias("average_delay_days"), F.round(F.sum("lost_units") / F.greatest(F.sum("requested_units"), F.lit(1)), 6).alias("lost_rate"), F.bool_and(F.col("requested_units") >= F.col("fulfilled_units")).alias("never_over"), F.round(F.stddev_samp("requested_units"), 6).alias("deviation"), F.min("transaction_ts").isNotNull().alias("has_first"),
    )


@query("""WITH m AS (SELECT count(*)::DOUBLE AS attempts, sum(requested_units)::DOUBLE AS requested, sum(fulfilled_units)::DOUBLE AS fulfilled, sum(lost_units)::DOUBLE AS lost FROM demand_attempt) SELECT metric, value FROM m UNPIVOT (value FOR metric IN (attempts, requested, fulfilled, lost))""")
def ag_17_metrics_as_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A wide row of metrics as one row a metric."""
    wide = table(spark, folder, "demand_attempt").agg(F.count(F.lit(1)).cast("double").alias("attempts"), *[F.sum(f"{c}_units").cast("double").alias(c) for c in ("requested", "fulfilled", "lost")])
    return wide.unpivot([], ["attempts", "requested", "fulfilled", "lost"], "metric", "value")


@query("SELECT stage, '{' || string_agg('\"' || status || '\":' || n, ',' ORDER BY status) || '}' AS counts FROM (SELECT stage, status, count(*) AS n FROM ingestion_run WHERE status IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def ag_18_counts_as_object(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by status as one JSON object a stage, keys in order; a stage has few statuses."""
    counts = table(spark, folder, "ingestion_run").filter("status IS NOT NULL").groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("status", "n")))
    return counts.groupBy("stage").agg(F.to_json(F.map_from_entries(entries)).alias("counts"))


@query("""WITH days AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS day FROM (SELECT (transaction_ts AT TIME ZONE 'UTC')::DATE AS d FROM sale_header)),
n AS (SELECT branch_id, (transaction_ts AT TIME ZONE 'UTC')::DATE AS day, count(*) AS sales, sum(net_sales_egp) AS net_sales FROM sale_header GROUP BY 1, 2)
SELECT b.branch_id, days.day::VARCHAR AS day, coalesce(sales, 0) AS sales, coalesce(net_sales, 0)::DECIMAL(26, 2) AS net_sales FROM pharmacy_branch AS b CROSS JOIN days LEFT JOIN n ON n.branch_id = b.branch_id AND n.day = days.day""")
def ag_19_branch_days_with_zeros(spark: SparkSession, folder: str) -> DataFrame:
    """Each branch and day, closed days with zeros: the calendar is one row, an array."""
    sales = _sales(spark, folder).withColumn("day", utc_day("transaction_ts"))
    calendar = sales.agg(F.sequence(F.min("day"), F.max("day")).alias("calendar"))
    grid = table(spark, folder, "pharmacy_branch").select("branch_id").join(F.broadcast(calendar)).select("branch_id", F.explode("calendar").alias("day"))
    sums = sales.groupBy("branch_id", "day").agg(F.count(F.lit(1)).alias("sales"), F.sum("net_sales_egp").alias("net_sales"))
    filled = grid.join(sums, ["branch_id", "day"], "left")
    return filled.select("branch_id", F.col("day").cast("string").alias("day"), F.coalesce("sales", F.lit(0).cast("long")).alias("sales"), F.coalesce("net_sales", F.lit(0).cast("decimal(26,2)")).alias("net_sales"))


@query("SELECT coalesce(nullif(trim(lower(channel)), ''), 'UNKNOWN') AS channel, count(*) AS sales FROM sale_header GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def ag_20_most_common(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve most common channels (a top-k report)."""
    channel = F.coalesce(F.nullif(F.trim(F.lower("channel")), F.lit("")), F.lit("UNKNOWN"))
    return _sales(spark, folder).groupBy(channel.alias("channel")).agg(F.count(F.lit(1)).alias("sales")).orderBy(F.col("sales").desc(), "channel").limit(12)


@query("""SELECT currency, round(median(price_egp::DOUBLE), 6) AS median_price, round(quantile_cont(price_egp::DOUBLE, 0.25), 6) AS lower_quartile, quantile_disc(price_egp::DOUBLE, 0.9) AS nearest_p90, count(price_egp) AS prices FROM product_price_history GROUP BY 1""")
def ag_21_order_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Interpolated and nearest-rank quantiles, exact: the state counts each distinct value."""
    price = "cast(price_egp AS double)"
    interpolated = lambda q: F.round(F.percentile(F.col("price_egp").cast("double"), F.lit(q)), 6)
    nearest = F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {price})")
    return table(spark, folder, "product_price_history").groupBy("currency").agg(interpolated(0.5).alias("median_price"), interpolated(0.25).alias("lower_quartile"), nearest.alias("nearest_p90"), F.count("price_egp").alias("prices"))


@query("""WITH p AS (SELECT product_id, sum(net_sales_egp) AS net_sales FROM sale_line WHERE product_id IS NOT NULL GROUP BY 1), q AS (SELECT *, ntile(4) OVER (ORDER BY net_sales, product_id) AS quarter FROM p) SELECT quarter::INT AS quarter, count(*) AS products, min(net_sales) AS least, max(net_sales) AS greatest FROM q GROUP BY 1""")
def ag_22_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    """Products in quarters by sales, ranked by a range-partitioned sort."""
    totals = _lines(spark, folder).filter("product_id IS NOT NULL").groupBy("product_id").agg(F.sum("net_sales_egp").alias("net_sales"))
    quarters = ranked(totals, "net_sales", "product_id").withColumn("quarter", tile(F.col("rank"), F.col("rank_count"), 4))
    return quarters.groupBy("quarter").agg(F.count(F.lit(1)).alias("products"), F.min("net_sales").alias("least"), F.max("net_sales").alias("greatest"))


@query("SELECT product_id, list_sort(list(DISTINCT source_system) FILTER (source_system IS NOT NULL))::VARCHAR AS systems, count(DISTINCT source_system) > 1 AS mixed FROM product_price_history GROUP BY 1")
def ag_24_source_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The systems that tell each product's prices, and whether they are several."""
    systems = F.array_sort(F.collect_set("source_system"))
    shown = F.concat(F.lit("["), F.concat_ws(", ", systems), F.lit("]"))
    return table(spark, folder, "product_price_history").groupBy("product_id").agg(shown.alias("systems"), (F.size(systems) > 1).alias("mixed"))


@query("""SELECT sale_line_id, branch_sales, running_units FROM (SELECT sale_line_id, count(*) OVER (PARTITION BY product_id, created_at) AS branch_sales,
  sum(quantity) OVER (PARTITION BY product_id, (created_at AT TIME ZONE 'UTC')::DATE ORDER BY created_at, sale_line_id, sale_id, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running_units FROM (SELECT DISTINCT sale_line_id, sale_id, line_number, product_id, quantity, created_at FROM sale_line WHERE product_id IS NOT NULL))""")
def wn_07_running_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Units sold of each product so far on its day, line by line; a product with most lines of a day has many tasks."""
    lines = _lines(spark, folder).filter("product_id IS NOT NULL").select("sale_line_id", "sale_id", "line_number", "product_id", "quantity", "created_at").distinct().withColumn("day", utc_day("created_at"))
    running = along(lines, ["product_id", "day"], ["created_at", "sale_line_id", "sale_id", "line_number"], {"running_units": F.col("quantity")})
    together = lines.groupBy(F.col("product_id").alias("p"), F.col("created_at").alias("c")).agg(F.count(F.lit(1)).alias("branch_sales"))
    joined = running.join(together, (F.col("product_id") == F.col("p")) & F.col("created_at").eqNullSafe(F.col("c")))
    return joined.select("sale_line_id", "branch_sales", "running_units")


@query("""SELECT branch_id, governorate_rank::INT AS governorate_rank, place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY governorate_rank = 1 DESC, demand_index DESC NULLS LAST, branch_id) AS place FROM (SELECT branch_id, demand_index, row_number() OVER (PARTITION BY governorate ORDER BY demand_index DESC NULLS LAST, branch_id) AS governorate_rank FROM pharmacy_branch))""")
def wn_14_rank_then_prioritise(spark: SparkSession, folder: str) -> DataFrame:
    """Branches ranked within their governorate; each one's first comes before all others. 120 rows, fixed."""
    inner = F.row_number().over(Window.partitionBy("governorate").orderBy(F.col("demand_index").desc_nulls_last(), "branch_id"))
    inside = table(spark, folder, "pharmacy_branch").withColumn("governorate_rank", inner)
    place = F.row_number().over(Window.orderBy((F.col("governorate_rank") == 1).desc(), F.col("demand_index").desc_nulls_last(), "branch_id"))
    return inside.select("branch_id", "governorate_rank", place.alias("place"))


@query("""SELECT sale_id, sale_line_id, row_number() OVER (PARTITION BY sale_id ORDER BY product_id NULLS LAST, sale_line_id)::INT AS new_line_number FROM (SELECT DISTINCT sale_id, sale_line_id, product_id FROM sale_line WHERE sale_id IS NOT NULL)""")
def wn_15_line_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Lines numbered anew within their sale."""
    lines = _lines(spark, folder).filter("sale_id IS NOT NULL").select("sale_id", "sale_line_id", "product_id").distinct()
    number = F.row_number().over(Window.partitionBy("sale_id").orderBy(F.col("product_id").asc_nulls_last(), "sale_line_id"))
    return lines.select("sale_id", "sale_line_id", number.alias("new_line_number"))


@query("""SELECT product_id, 'asked' AS side FROM (SELECT product_id FROM demand_attempt WHERE product_id IS NOT NULL EXCEPT SELECT product_id FROM sale_line) UNION ALL SELECT product_id, 'sold' FROM (SELECT product_id FROM sale_line WHERE product_id IS NOT NULL EXCEPT SELECT product_id FROM demand_attempt)
UNION ALL SELECT product_id, 'both' FROM (SELECT product_id FROM sale_line WHERE product_id IS NOT NULL INTERSECT SELECT product_id FROM demand_attempt)""")
def st_03_set_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Products asked for only, sold only, or both: set operations on distinct keys."""
    keys = lambda rows: rows.select("product_id").filter("product_id IS NOT NULL").distinct()
    asked, sold = keys(table(spark, folder, "demand_attempt")), keys(_lines(spark, folder))
    side = lambda rows, name: rows.withColumn("side", F.lit(name))
    return side(asked.join(sold, "product_id", "left_anti"), "asked").unionByName(side(sold.join(asked, "product_id", "left_anti"), "sold")).unionByName(side(asked.join(sold, "product_id", "left_semi"), "both"))
