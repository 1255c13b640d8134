"""Feature tables in full: product histories, pair histories and current policy features, with supply; trends by branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import EXPIRY, floored_ratio, ladder, rate
from ..operators.sampling import top_of_each, within_budget
from ..operators.series import ahead, back, forward_filled
from ..registry import ORACLES, query
from ..session import table
from .feature_queries import _closing
from .mart_queries import _EVENTS, _field, _payloads, mart_product_daily_performance
from .relational_queries import _ORDERS, jn_15_latest_supplier
from .serving_queries import _COMPLETE, _trend_days, branch_daily
from .warehouse_queries import _POSITION, _SUPPLY, _position, _supply

#: Rows that training takes at most, in whole histories.
BUDGET = 500_000
#: Days and reliability of a supplier that nothing is known of.
LEAD_DAYS, RELIABILITY = 3.0, 0.9


_OVER = "OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN {0} PRECEDING AND 1 PRECEDING)"
_NEXT = "OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND {0} FOLLOWING)"


@query(f"""WITH m AS ({ORACLES["mart_product_daily_performance"]}), b AS (SELECT min(day::DATE) AS a, max(day::DATE) AS z FROM m), p AS (SELECT product_id, max(retail_unit_price_egp)::DOUBLE AS price FROM sale_line GROUP BY 1),
chosen AS (SELECT product_id FROM (SELECT product_id, row_number() OVER (ORDER BY md5(product_id), product_id) AS k FROM (SELECT DISTINCT product_id FROM m)), b WHERE k <= greatest(1, {BUDGET} // greatest(z - a + 1, 1))),
grid AS (SELECT product_id, day FROM chosen, (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM b)),
s AS (SELECT g.product_id, g.day, (g.day - DATE '1970-01-01')::BIGINT AS n, coalesce(p.price, 0) AS price, coalesce(selling_branches, 0) AS selling_branches, coalesce(transactions, 0) AS transactions, coalesce(units_sold, 0) AS units_sold, coalesce(requested, 0) AS requested, coalesce(fulfilled, 0) AS fulfilled, coalesce(lost, 0) AS lost, coalesce(fill_rate, 1.0) AS fill_rate,
  coalesce(stockouts, 0) AS stockouts, coalesce(net_sales, 0)::DOUBLE AS net_sales, coalesce(gross_profit, 0)::DOUBLE AS gross_profit FROM grid AS g LEFT JOIN m ON m.product_id = g.product_id AND m.day::DATE = g.day LEFT JOIN p ON p.product_id = g.product_id),
f AS (SELECT *, dayofweek(day)::INT + 1 AS day_of_week, month(day)::INT AS month_of_year, lost / greatest(requested, 1) AS lost_rate, lag(requested, 1) OVER w AS lag_1, lag(requested, 7) OVER w AS lag_7, lag(requested, 14) OVER w AS lag_14, lag(requested, 28) OVER w AS lag_28, avg(requested) {_OVER.format(7)} AS avg_7, avg(requested) {_OVER.format(28)} AS avg_28,
  stddev_samp(requested) {_OVER.format(28)} AS stddev_28, avg(stockouts) {_OVER.format(7)} AS stockout_avg_7, sum(requested) {_NEXT.format(1)} AS next_1d, sum(requested) {_NEXT.format(7)} AS next_7d, sum(requested) {_NEXT.format(14)} AS next_14d, sum(requested) {_NEXT.format(30)} AS next_30d FROM s WINDOW w AS (PARTITION BY product_id ORDER BY day))
SELECT product_id, day::VARCHAR AS day, round(price, 6) AS price, selling_branches, transactions, units_sold, requested, fulfilled, lost, round(fill_rate, 6) AS fill_rate, stockouts, round(net_sales, 2) AS net_sales, round(gross_profit, 2) AS gross_profit, day_of_week, month_of_year, round(lost_rate, 6) AS lost_rate, lag_1, lag_7, lag_14, lag_28, round(avg_7, 6) AS avg_7, round(avg_28, 6) AS avg_28, round(stddev_28, 6) AS stddev_28,
  round(stockout_avg_7, 6) AS stockout_avg_7, round(avg_7 / greatest(avg_28, 1.0), 6) AS trend, next_1d::BIGINT AS next_1d, next_7d::BIGINT AS next_7d, next_14d::BIGINT AS next_14d, next_30d::BIGINT AS next_30d FROM f WHERE lag_28 IS NOT NULL AND next_1d IS NOT NULL""")
def q_dfeat_product_history(spark: SparkSession, folder: str) -> DataFrame:
    """All 23 features and four labels of whole product histories within the budget of training rows, in hash order."""
    own = ["product_id"]
    mart = mart_product_daily_performance(spark, folder).withColumn("day", F.to_date("day"))
    prices = table(spark, folder, "sale_line").groupBy(*own).agg(F.max("retail_unit_price_egp").cast("double").alias("price"))
    bounds = mart.agg(F.min("day").alias("a"), F.max("day").alias("z")).first()  # two days
    if bounds["a"] is None:
        days, taken = F.array().cast("array<date>"), 1
    else:
        days, taken = F.sequence(F.lit(bounds["a"]), F.lit(bounds["z"])), max(1, BUDGET // ((bounds["z"] - bounds["a"]).days + 1))
    # whole histories: as many products as the budget has room for, and the days of the calendar for each
    chosen = mart.select(*own).distinct().orderBy(F.md5("product_id"), "product_id").limit(taken)
    grid = chosen.join(prices, own, "left").select(*own, F.coalesce("price", F.lit(0.0)).alias("price"), F.explode(days).alias("day"))
    counts = ["selling_branches", "transactions", "units_sold", "requested", "fulfilled", "lost", "stockouts"]
    money = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("net_sales", "gross_profit")]
    series = grid.join(mart, [*own, "day"], "left").select(*own, "day", "price", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("fill_rate", F.lit(1.0)).alias("fill_rate"), *money)
    rows = Window.partitionBy(*own).orderBy("day")
    r = F.col("requested")
    features = series.select(
        "*", F.dayofweek("day").alias("day_of_week"), F.month("day").alias("month_of_year"), floored_ratio(F.col("lost"), r).alias("lost_rate"), *[F.lag(r, k).over(rows).alias(f"lag_{k}") for k in (1, 7, 14, 28)],
        F.avg(r).over(back(own, "day", 7)).alias("avg_7"), F.avg(r).over(back(own, "day", 28)).alias("avg_28"), F.stddev_samp(r).over(back(own, "day", 28)).alias("stddev_28"), F.avg("stockouts").over(back(own, "day", 7)).alias("stockout_avg_7"), *[F.sum(r).over(ahead(own, "day", k)).alias(f"next_{k}d") for k in (1, 7, 14, 30)],
    ).filter("lag_28 IS NOT NULL AND next_1d IS NOT NULL")
    trend = F.round(F.col("avg_7") / F.greatest("avg_28", F.lit(1.0)), 6)
    rounded = {c: F.round(c, 6) for c in ("price", "fill_rate", "lost_rate", "avg_7", "avg_28", "stddev_28", "stockout_avg_7")} | {c: F.round(c, 2) for c in ("net_sales", "gross_profit")}
    return features.withColumns({"trend": trend, **rounded, "day": F.col("day").cast("string")})


_BRANCH_SUPPLY = f"""{_ORDERS}, {_SUPPLY}, latest AS (SELECT branch_id, supplier_id FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY kafka_timestamp DESC, kafka_topic DESC, kafka_partition DESC, kafka_offset DESC) AS k FROM orders_seen WHERE branch_id IS NOT NULL) WHERE k = 1),
branch_supply AS (SELECT branch_id, average_lead_days AS lead_days, CASE WHEN goods_receipts > 0 THEN round(1 - delayed_receipts / goods_receipts, 6) END AS reliability FROM latest LEFT JOIN supply USING (supplier_id))"""


def _branch_supply(spark: SparkSession, folder: str) -> DataFrame:
    """The lead time and reliability of each branch's newest supplier, as its orders and receipts show them."""
    shown = _supply(spark, folder).select("supplier_id", F.col("average_lead_days").alias("lead_days"), F.when(F.col("goods_receipts") > 0, F.round(1 - F.col("delayed_receipts") / F.col("goods_receipts"), 6)).alias("reliability"))
    return jn_15_latest_supplier(spark, folder).join(shown, "supplier_id", "left").select("branch_id", "lead_days", "reliability")


_PAIRS = """pd AS (SELECT branch_id, product_id, (transaction_ts AT TIME ZONE 'UTC')::DATE AS day, sum(requested_units)::BIGINT AS requested, sum(fulfilled_units)::BIGINT AS fulfilled, sum(lost_units)::BIGINT AS lost, max(CASE WHEN outcome = 'OUT_OF_STOCK' THEN 1 ELSE 0 END)::BIGINT AS stockout_today
  FROM demand_attempt WHERE branch_id IS NOT NULL AND product_id IS NOT NULL AND transaction_ts IS NOT NULL GROUP BY 1, 2, 3)"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "demand_attempt").filter("branch_id IS NOT NULL AND product_id IS NOT NULL AND transaction_ts IS NOT NULL")
    day = F.expr("date_from_unix_date(cast(floor(unix_micros(transaction_ts) / 86400000000D) AS int))")
    return rows.groupBy("branch_id", "product_id", day.alias("day")).agg(F.sum("requested_units").alias("requested"), F.sum("fulfilled_units").alias("fulfilled"), F.sum("lost_units").alias("lost"), F.max(F.when(F.col("outcome") == "OUT_OF_STOCK", 1).otherwise(0)).cast("long").alias("stockout_today"))


_P = "OVER (PARTITION BY branch_id, product_id ORDER BY n RANGE BETWEEN {0} PRECEDING AND 1 PRECEDING)"
_N = "OVER (PARTITION BY branch_id, product_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND {0} FOLLOWING)"


@query(f"""WITH {_POSITION}, {_BRANCH_SUPPLY}, {_PAIRS}, sizes AS (SELECT branch_id, product_id, count(*) AS c, md5(branch_id || '|' || product_id) AS h FROM pd GROUP BY 1, 2), placed AS (SELECT *, sum(c) OVER (ORDER BY h, branch_id, product_id ROWS UNBOUNDED PRECEDING) AS so_far, row_number() OVER (ORDER BY h, branch_id, product_id) AS k FROM sizes),
j AS (SELECT pd.*, (pd.day - DATE '1970-01-01')::BIGINT AS n, closing_units FROM pd JOIN (SELECT branch_id, product_id FROM placed WHERE so_far <= {BUDGET} OR k = 1) USING (branch_id, product_id) LEFT JOIN closing USING (branch_id, product_id, day)),
f AS (SELECT *, coalesce(last_value(closing_units IGNORE NULLS) OVER (PARTITION BY branch_id, product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS available_units, avg(requested) {_P.format(7)} AS avg_7, avg(requested) {_P.format(28)} AS avg_28, stddev_samp(requested) {_P.format(28)} AS stddev_28,
  sum(lost) {_P.format(28)} / greatest(sum(coalesce(requested, 0)) {_P.format(28)}, 1) AS lost_rate_28, avg(stockout_today) {_P.format(28)} AS stockout_rate_28, max(stockout_today) {_N.format(7)} AS stockout_next_7d, sum(coalesce(requested, 0)) {_N.format(7)} AS demand_next_7d, sum(coalesce(requested, 0)) {_N.format(14)} AS demand_next_14d, sum(coalesce(requested, 0)) {_N.format(21)} AS demand_next_21d FROM j)
SELECT branch_id, product_id, day::VARCHAR AS day, available_units, round(avg_7, 6) AS avg_7, round(avg_28, 6) AS avg_28, round(stddev_28, 6) AS stddev_28, round(lost_rate_28, 6) AS lost_rate_28, round(stockout_rate_28, 6) AS stockout_rate_28, stockout_next_7d, demand_next_7d::BIGINT AS demand_next_7d, demand_next_14d::BIGINT AS demand_next_14d, demand_next_21d::BIGINT AS demand_next_21d, requested, fulfilled, lost,
  dayofweek(day)::INT + 1 AS day_of_week, month(day)::INT AS month_of_year, coalesce(lead_days, {LEAD_DAYS})::DOUBLE AS supplier_lead_days, coalesce(reliability, {RELIABILITY})::DOUBLE AS supplier_reliability, 0.0::DOUBLE AS inbound_units FROM f LEFT JOIN branch_supply USING (branch_id) WHERE avg_28 IS NOT NULL AND stockout_next_7d IS NOT NULL AND demand_next_21d IS NOT NULL""")
def q_sfeat_pair_history(spark: SparkSession, folder: str) -> DataFrame:
    """Days with demand of whole pair histories within the budget: stock carried forward, figures before, supply, labels ahead."""
    own = ["branch_id", "product_id"]
    daily = within_budget(_pairs(spark, folder), own, BUDGET, F.concat_ws("|", *own))
    joined = daily.join(_closing(spark, folder), [*own, "day"], "left")
    before, r = back(own, "day", 28), F.col("requested")
    features = joined.select(
        *own, "day", F.coalesce(forward_filled("closing_units", own, "day"), F.lit(0).cast("long")).alias("available_units"), F.avg(r).over(back(own, "day", 7)).alias("avg_7"), F.avg(r).over(before).alias("avg_28"), F.stddev_samp(r).over(before).alias("stddev_28"),
        floored_ratio(F.sum("lost").over(before), F.sum(F.coalesce(r, F.lit(0))).over(before)).alias("lost_rate_28"), F.avg("stockout_today").over(before).alias("stockout_rate_28"), F.max("stockout_today").over(ahead(own, "day", 7)).alias("stockout_next_7d"),
        *[F.sum(F.coalesce(r, F.lit(0))).over(ahead(own, "day", k)).alias(f"demand_next_{k}d") for k in (7, 14, 21)], "requested", "fulfilled", "lost", F.dayofweek("day").alias("day_of_week"), F.month("day").alias("month_of_year"),
    ).filter("avg_28 IS NOT NULL AND stockout_next_7d IS NOT NULL AND demand_next_21d IS NOT NULL")
    full = features.join(_branch_supply(spark, folder), "branch_id", "left")
    supply = {"supplier_lead_days": F.coalesce("lead_days", F.lit(LEAD_DAYS)), "supplier_reliability": F.coalesce("reliability", F.lit(RELIABILITY)), "inbound_units": F.lit(0.0)}
    return full.withColumns({**supply, **{c: F.round(c, 6) for c in ("avg_7", "avg_28", "stddev_28", "lost_rate_28", "stockout_rate_28")}, "day": F.col("day").cast("string")}).drop("lead_days", "reliability")


@query(f"""WITH {_POSITION}, {_BRANCH_SUPPLY}, {_PAIRS}, a AS (SELECT max(day) AS as_of FROM pd), d AS (SELECT branch_id, product_id, avg(requested) AS mean, stddev_samp(requested) AS sd, avg(fulfilled) AS sold, sum(lost) / greatest(sum(requested), 1) AS lost_rate FROM pd, a WHERE day >= as_of - 35 GROUP BY 1, 2),
got AS (SELECT DISTINCT order_id FROM receipts), i AS (SELECT branch_id, sum(u)::BIGINT AS inbound_units FROM (SELECT payload->>'$.purchase_order_id' AS k, branch_id, max(TRY_CAST(payload->>'$.ordered_units' AS BIGINT)) AS u FROM ok WHERE event_type = 'purchase_order.created' AND k IS NOT NULL AND branch_id IS NOT NULL GROUP BY 1, 2) WHERE k NOT IN (SELECT order_id FROM got) GROUP BY 1)
SELECT branch_id, product_id, coalesce(on_hand, 0) AS on_hand, coalesce(reorder_point, 0) AS reorder_point, round(coalesce(mean, 0), 6) AS avg_requested, round(coalesce(sd, 0), 6) AS stddev_requested, round(coalesce(sold, 0), 6) AS avg_sold, round(coalesce(lost_rate, 0), 6) AS lost_rate, coalesce(lead_days, {LEAD_DAYS})::DOUBLE AS supplier_lead_days, coalesce(reliability, {RELIABILITY})::DOUBLE AS supplier_reliability,
  coalesce(inbound_units, 0) AS branch_inbound_units, coalesce(on_hand = 0, false) AS zero_stock, coalesce(on_hand <= reorder_point, false) AS below_reorder, greatest(coalesce(target_stock_level, 0) - coalesce(on_hand, 0), 0) AS units_to_target, round(coalesce(on_hand, 0) / greatest(coalesce(mean, 0), 0.1), 6) AS cover_days FROM position LEFT JOIN d USING (branch_id, product_id) LEFT JOIN branch_supply USING (branch_id) LEFT JOIN i USING (branch_id)""")
def q_inv_policy_features(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair's stock, demand of the last 36 days, supply, what its branch still expects, and flags. No table has reserved units."""
    own = ["branch_id", "product_id"]
    daily = _pairs(spark, folder)
    last = daily.agg(F.max("day").alias("as_of"))  # one row
    recent = daily.join(F.broadcast(last), F.col("day") >= F.date_sub("as_of", 35)).groupBy(*own).agg(F.avg("requested").alias("mean"), F.stddev_samp("requested").alias("sd"), F.avg("fulfilled").alias("sold"), floored_ratio(F.sum("lost"), F.sum("requested")).alias("lost_share"))
    order = _field("purchase_order_id").alias("order_id")
    ordered = _payloads(spark, folder, "purchase_order.created").groupBy(order, _field("branch_id").alias("branch_id")).agg(F.max(_field("ordered_units").try_cast("long")).alias("units")).dropna(subset=["order_id", "branch_id"])
    received = _payloads(spark, folder, "goods_receipt.received").select(order).distinct()
    inbound = ordered.join(received, "order_id", "left_anti").groupBy("branch_id").agg(F.sum("units").alias("inbound"))
    joined = _position(spark, folder).join(recent, own, "left").join(_branch_supply(spark, folder), "branch_id", "left").join(inbound, "branch_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select(
        *own, zero("on_hand").alias("on_hand"), zero("reorder_point").alias("reorder_point"), *[F.round(number(c), 6).alias(n) for c, n in (("mean", "avg_requested"), ("sd", "stddev_requested"), ("sold", "avg_sold"), ("lost_share", "lost_rate"))],
        F.coalesce("lead_days", F.lit(LEAD_DAYS)).alias("supplier_lead_days"), F.coalesce("reliability", F.lit(RELIABILITY)).alias("supplier_reliability"), zero("inbound").alias("branch_inbound_units"), F.coalesce(F.col("on_hand") == 0, F.lit(False)).alias("zero_stock"),
        F.coalesce(F.col("on_hand") <= F.col("reorder_point"), F.lit(False)).alias("below_reorder"), F.greatest(zero("target_stock_level") - zero("on_hand"), F.lit(0)).alias("units_to_target"), F.round(zero("on_hand") / F.greatest(number("mean"), F.lit(0.1)), 6).alias("cover_days"),
    )


@query(f"""WITH m AS ({ORACLES["mart_product_daily_performance"]}), p AS (SELECT product_id, max(retail_unit_price_egp)::DOUBLE AS price FROM sale_line GROUP BY 1)
SELECT product_id, max(price) AS price, round(avg(requested), 6) AS avg_requested, round(stddev_samp(requested), 6) AS std_requested, round(avg(selling_branches), 6) AS avg_selling_branches, round(sum(transactions) / greatest(sum(requested), 1), 6) AS transactions_per_unit, round(sum(lost) / greatest(sum(requested), 1), 6) AS lost_rate FROM m LEFT JOIN p USING (product_id) GROUP BY 1""")
def q_dseed_calibration_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """What calibrates a product's history: price, mean and deviation of demand, branches, transactions a unit, lost rate."""
    prices = table(spark, folder, "sale_line").groupBy("product_id").agg(F.max("retail_unit_price_egp").cast("double").alias("price"))
    per = lambda c: F.round(floored_ratio(F.sum(c), F.sum("requested")), 6)
    stats = mart_product_daily_performance(spark, folder).groupBy("product_id").agg(F.round(F.avg("requested"), 6).alias("avg_requested"), F.round(F.stddev_samp("requested"), 6).alias("std_requested"), F.round(F.avg("selling_branches"), 6).alias("avg_selling_branches"), per("transactions").alias("transactions_per_unit"), per("lost").alias("lost_rate"))
    return stats.join(prices, "product_id", "left")


@query(f"""{_COMPLETE}, k AS (SELECT * FROM days WHERE status = 'COMPLETE'), a AS (SELECT max(business_date) AS as_of FROM k), w AS (SELECT d.branch_id, d.business_date, sum(d.requested_units)::BIGINT AS requested, sum(d.fulfilled_units)::BIGINT AS fulfilled, sum(d.attempts)::BIGINT AS attempts FROM daily AS d JOIN k ON d.business_date = k.business_date, a WHERE d.business_date BETWEEN as_of - 27 AND as_of AND d.branch_id IS NOT NULL GROUP BY 1, 2)
SELECT branch_id, count(*) AS days, sum(attempts)::BIGINT AS attempts, arg_min(requested, business_date) AS first_units, arg_max(requested, business_date) AS last_units, arg_max(requested, business_date) - arg_min(requested, business_date) AS change, round(avg(CASE WHEN requested > 0 THEN round(fulfilled / requested, 6) END), 6) AS average_fill,
  max(requested) AS greatest_units, min(requested) AS least_units, 'OBSERVED' AS provenance FROM w GROUP BY 1""")
def q_trend_by_branch(spark: SparkSession, folder: str) -> DataFrame:
    """How demand of each branch changed over the network's complete days; all of the tables' rows were observed."""
    days = _trend_days(spark, folder).select("business_date")
    daily = branch_daily(table(spark, folder, "demand_attempt")).filter("branch_id IS NOT NULL").groupBy("branch_id", "business_date").agg(*[F.sum(c).alias(n) for c, n in (("requested_units", "requested"), ("fulfilled_units", "fulfilled"), ("attempts", "attempts"))])
    day, units = F.col("business_date"), F.col("requested")
    ends = daily.join(days, "business_date").groupBy("branch_id").agg(F.count(F.lit(1)).alias("days"), F.sum("attempts").alias("attempts"), F.min_by(units, day).alias("first_units"), F.max_by(units, day).alias("last_units"), F.round(F.avg(rate(F.col("fulfilled"), units)), 6).alias("average_fill"), F.max(units).alias("greatest_units"), F.min(units).alias("least_units"))
    return ends.withColumns({"change": F.col("last_units") - F.col("first_units"), "provenance": F.lit("OBSERVED")})


@query(f"""WITH {_PAIRS}, d AS (SELECT branch_id, product_id, round(avg(stockout_today), 6) AS stockout_rate, sum(lost)::BIGINT AS lost FROM pd GROUP BY 1, 2) SELECT branch_id, product_id, stockout_rate, lost, row_number() OVER (PARTITION BY branch_id ORDER BY stockout_rate DESC NULLS LAST, lost DESC NULLS LAST, product_id) AS evidence_rank FROM d""")
def wn_17_ranked_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of each branch in order of how often they ran out, unknown rates last; pairs are folded before they are ranked."""
    pairs = _pairs(spark, folder).groupBy("branch_id", "product_id").agg(F.round(F.avg("stockout_today"), 6).alias("stockout_rate"), F.sum("lost").alias("lost"))
    order = Window.partitionBy("branch_id").orderBy(F.col("stockout_rate").desc_nulls_last(), F.col("lost").desc_nulls_last(), "product_id")
    return pairs.withColumn("evidence_rank", F.row_number().over(order).cast("long"))


_LOTS = f"""{_PAIRS}, a AS (SELECT max(day) AS as_of FROM pd), recent AS (SELECT branch_id, product_id, avg(fulfilled) AS sold, avg(requested) AS mean, stddev_samp(requested) AS sd FROM pd, a WHERE day >= as_of - 35 GROUP BY 1, 2),
lots AS (SELECT lot_id, min(branch_id) AS branch_id, min(product_id) AS product_id, min(day) AS received_on, max(units) AS units FROM (SELECT payload->>'$.movement_id' AS lot_id, branch_id, product_id, (moment AT TIME ZONE 'UTC')::DATE AS day, TRY_CAST(payload->>'$.quantity' AS BIGINT) AS units FROM ok WHERE event_type = 'restock.applied' AND moment IS NOT NULL) WHERE lot_id IS NOT NULL GROUP BY 1),
lot_features AS (SELECT lot_id, l.branch_id, l.product_id, a.as_of - received_on AS age_days, units, round(coalesce(sold, 0), 6) AS avg_sold, round(coalesce(mean, 0), 6) AS avg_requested, round(coalesce(sd, 0), 6) AS stddev_requested, round(units / greatest(coalesce(sold, 0), 0.1), 6) AS cover_days,
  CASE WHEN a.as_of - received_on <= 30 THEN '00_30' WHEN a.as_of - received_on <= 60 THEN '31_60' WHEN a.as_of - received_on <= 90 THEN '61_90' WHEN a.as_of - received_on <= 180 THEN '91_180' WHEN a.as_of - received_on <= 365 THEN '181_365' ELSE '366_plus' END AS age_step FROM lots AS l CROSS JOIN a LEFT JOIN recent AS r ON r.branch_id = l.branch_id AND r.product_id = l.product_id WHERE units > 0)"""


@query(f"WITH {_EVENTS}, {_LOTS} SELECT * FROM lot_features")
def q_oexp_lot_features(spark: SparkSession, folder: str) -> DataFrame:
    """Each lot that a restock brought: its age, units, the recent demand of its pair, and the days it covers. No table has lots' expiry, so age stands for it."""
    own = ["branch_id", "product_id"]
    daily = _pairs(spark, folder)
    last = daily.agg(F.max("day").alias("as_of"))  # one row
    recent = daily.join(F.broadcast(last), F.col("day") >= F.date_sub("as_of", 35)).groupBy(*own).agg(F.avg("fulfilled").alias("sold"), F.avg("requested").alias("mean"), F.stddev_samp("requested").alias("sd"))
    restocks = _payloads(spark, folder, "restock.applied").filter("moment IS NOT NULL").groupBy(_field("movement_id").alias("lot_id"))
    lots = restocks.agg(F.min(_field("branch_id")).alias("branch_id"), F.min(_field("product_id")).alias("product_id"), F.min("day").alias("received_on"), F.max(_field("quantity").try_cast("long")).alias("units")).filter("lot_id IS NOT NULL AND units > 0")
    joined = lots.join(F.broadcast(last)).join(recent, own, "left").withColumn("age_days", F.datediff("as_of", "received_on"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    figures = [F.round(number(c), 6).alias(n) for c, n in (("sold", "avg_sold"), ("mean", "avg_requested"), ("sd", "stddev_requested"))]
    return joined.select("lot_id", *own, F.col("age_days").cast("long").alias("age_days"), "units", *figures, F.round(F.col("units") / F.greatest(number("sold"), F.lit(0.1)), 6).alias("cover_days"), ladder(F.col("age_days"), *EXPIRY).alias("age_step"))


@query(f"WITH {_EVENTS}, {_LOTS} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY age_step ORDER BY md5(lot_id), lot_id) AS k FROM lot_features) WHERE k <= {-(-BUDGET // 6)}")
def q_exp_lot_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Lots of every age step in hash order, at most a sixth of the budget of training rows each: a sampling operator."""
    return top_of_each(q_oexp_lot_features(spark, folder), "age_step", [F.md5("lot_id"), F.col("lot_id")], -(-BUDGET // 6))


@query(f"""WITH {_EVENTS}, {_LOTS}, names AS (SELECT product_id, min(trade_name_en) AS trade_name_en, min(manufacturer) AS manufacturer FROM master_product GROUP BY 1)
SELECT lot_id, f.branch_id, branch_code, governorate, f.product_id, trade_name_en, manufacturer, age_days, units, cover_days, CASE WHEN age_days <= 30 THEN '0-30 days' WHEN age_days <= 90 THEN '31-90 days' WHEN age_days <= 180 THEN '91-180 days' ELSE '180+ days' END AS shown_step
FROM lot_features AS f LEFT JOIN pharmacy_branch AS b ON b.branch_id = f.branch_id LEFT JOIN names AS n ON n.product_id = f.product_id""")
def bi_v9_lots_by_age(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot of lots with names, by steps of age as they are shown; lots are folded before the dimensions meet them."""
    branches = table(spark, folder, "pharmacy_branch").select("branch_id", "branch_code", "governorate")
    names = table(spark, folder, "master_product").groupBy("product_id").agg(F.min("trade_name_en").alias("trade_name_en"), F.min("manufacturer").alias("manufacturer"))
    lots = q_oexp_lot_features(spark, folder).select("lot_id", "branch_id", "product_id", "age_days", "units", "cover_days")
    shown = ladder(F.col("age_days"), [(30, "0-30 days"), (90, "31-90 days"), (180, "91-180 days")], "180+ days")
    return lots.join(branches, "branch_id", "left").join(names, "product_id", "left").withColumn("shown_step", shown)
