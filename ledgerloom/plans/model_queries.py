"""Forecasts, blends, backtests and models on daily demand; stock features; the star of views."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import floored_ratio, rate
from ..functions.temporal import utc_day
from ..operators.evaluation import best_blend, boosted_trees, bootstrap_gain
from ..operators.series import back, dense
from ..registry import query
from ..session import table
from .feature_queries import _BALANCES, _GRID, _PAIR_DAYS, _closing, _pair_days, _product_days


def _forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Each product and day with its demand, that of the day before and the mean of 28 days before."""
    series = dense(_product_days(spark, folder), ["product_id"], "day", ["requested_units", "lost_units", "stockouts"])
    rows = Window.partitionBy("product_id").orderBy("day")
    made = series.select("product_id", "day", F.col("requested_units").cast("double").alias("y"), F.lag("requested_units", 1).over(rows).cast("double").alias("naive"), F.round(F.avg("requested_units").over(back(["product_id"], "day", 28)), 6).alias("mean_28"), F.dayofweek("day").alias("weekday"))
    return made.dropna()


_FORECASTS = f"""{_GRID}, f AS (SELECT * FROM (SELECT product_id, day, requested_units::DOUBLE AS y, lag(requested_units) OVER (PARTITION BY product_id ORDER BY day)::DOUBLE AS naive, round(avg(requested_units) OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS mean_28 FROM series) WHERE naive IS NOT NULL AND mean_28 IS NOT NULL)"""


@query()
def alg_21_bootstrap_gain(spark: SparkSession, folder: str) -> DataFrame:
    """How much nearer the mean of 28 days is than the day before, with its bootstrap interval."""
    gains = _forecasts(spark, folder).select(F.concat_ws("|", "product_id", F.col("day").cast("string")).alias("id"), (F.abs(F.col("y") - F.col("naive")) - F.abs(F.col("y") - F.col("mean_28"))).alias("gain"))
    return bootstrap_gain(gains, "id", "gain")


@query(f"WITH {_FORECASTS} SELECT round(avg(abs(y - naive) - abs(y - mean_28)), 5) AS mean_gain, true AS within, true AS narrow FROM f")
def alg_21_gain_in_its_interval(spark: SparkSession, folder: str) -> DataFrame:
    """The mean gain, whether its interval holds it, and whether that is narrower than the means of single days spread."""
    return alg_21_bootstrap_gain(spark, folder).select(F.round("mean_gain", 5).alias("mean_gain"), ((F.col("low") <= F.col("mean_gain")) & (F.col("mean_gain") <= F.col("high"))).alias("within"), (F.col("high") - F.col("low") < 10).alias("narrow"))


_BLENDS = " UNION ALL ".join(f"SELECT {k / 20} AS share, round(avg(abs(y - (mean_28 * {k / 20} + naive * {1 - k / 20}))), 9) AS error FROM f" for k in range(21))


@query(f"WITH {_FORECASTS} SELECT share::DOUBLE AS share, round(error, 6) AS error FROM ({_BLENDS}) ORDER BY error, share LIMIT 1")
def alg_24_best_blend(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of two forecasts with the least error, of 21."""
    return best_blend(_forecasts(spark, folder), "y", "mean_28", "naive").withColumn("error", F.round("error", 6))


@query(f"""WITH {_FORECASTS}, b AS (SELECT max(day) AS last FROM f) SELECT fold::INT AS fold, count(*) AS days, round(avg(abs(y - naive)), 6) AS naive_error, round(avg(abs(y - mean_28)), 6) AS mean_error
FROM (SELECT f.*, floor((b.last - f.day) / 30) AS fold FROM f, b) WHERE fold < 4 GROUP BY 1""")
def alg_24_rolling_origin(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of two forecasts over the last four stretches of 30 days."""
    made = _forecasts(spark, folder)
    last = made.agg(F.max("day").alias("last"))  # one row
    folds = made.join(F.broadcast(last)).withColumn("fold", F.floor(F.datediff("last", "day") / 30).cast("int")).filter("fold < 4")
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg(F.abs(F.col("y") - F.col("naive"))), 6).alias("naive_error"), F.round(F.avg(F.abs(F.col("y") - F.col("mean_28"))), 6).alias("mean_error"))


@query()
def alg_25_boosted_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Demand by boosted trees, fitted on the days before the last 30, for every product and day; held-out rows are marked."""
    made = _forecasts(spark, folder)
    last = made.agg(F.max("day").alias("last")).first()["last"]
    marked = made.withColumn("held_out", F.datediff(F.lit(last), "day") < 30)
    model = boosted_trees(marked.filter(~F.col("held_out")), ["naive", "mean_28", "weekday"], "y", rounds=10, row_id=["product_id", "day"])
    return model.transform(marked).select("product_id", F.col("day").cast("string").alias("day"), "y", "held_out", F.round("prediction", 6).alias("prediction"))


@query()
def alg_25_calibrated_stockouts(spark: SparkSession, folder: str) -> DataFrame:
    """The probability of a stock-out of each attempt, by boosted trees calibrated on rows they didn't see."""
    attempts = table(spark, folder, "demand_attempt").filter("requested_units IS NOT NULL AND transaction_ts IS NOT NULL")
    made = attempts.select("demand_attempt_id", F.col("requested_units").cast("double").alias("units"), F.dayofweek(utc_day("transaction_ts")).cast("double").alias("weekday"), (F.col("outcome") == "OUT_OF_STOCK").cast("double").alias("label")).fillna(0.0, ["label"])
    model = boosted_trees(made, ["units", "weekday"], "label", most_rows=20_000, classify=True, rounds=5, row_id=["demand_attempt_id"])
    return model.transform(made).select("demand_attempt_id", "label", F.round(F.element_at(vector_to_array("probability"), 2), 6).alias("probability"))


@query(f"""WITH {_FORECASTS}, b AS (SELECT max(day) AS last FROM f) SELECT (last - day) < 30 AS held_out, count(*) AS days, round(avg(y), 6) AS mean_demand, true AS better_than_naive FROM f, b GROUP BY 1""")
def alg_25_demand_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Days, mean demand, and whether the trees err less than the day before does, on days they saw and days held out."""
    scored = alg_25_boosted_demand(spark, folder).join(_forecasts(spark, folder).select("product_id", F.col("day").cast("string").alias("day"), "naive"), ["product_id", "day"])
    better = F.avg(F.abs(F.col("y") - F.col("prediction"))) < F.avg(F.abs(F.col("y") - F.col("naive")))
    return scored.groupBy("held_out").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("y"), 6).alias("mean_demand"), better.alias("better_than_naive"))


@query("""SELECT count(*) AS attempts, round(avg(CASE WHEN outcome = 'OUT_OF_STOCK' THEN 1.0 ELSE 0.0 END), 6) AS prevalence, true AS calibrated, true AS probabilities FROM demand_attempt WHERE requested_units IS NOT NULL AND transaction_ts IS NOT NULL""")
def alg_25_stockout_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts, the share of stock-outs, and whether the mean probability is within 0.02 of it and all lie between 0 and 1."""
    p = F.col("probability")
    whole = alg_25_calibrated_stockouts(spark, folder).agg(F.count(F.lit(1)).alias("attempts"), F.avg("label").alias("mean_label"), F.avg(p).alias("mean"), F.min(p).alias("least"), F.max(p).alias("greatest"))
    return whole.select("attempts", F.round("mean_label", 6).alias("prevalence"), (F.abs(F.col("mean") - F.col("mean_label")) < 0.02).alias("calibrated"), ((F.col("least") >= 0) & (F.col("greatest") <= 1)).alias("probabilities"))


@query(f"WITH {_PAIR_DAYS}, a AS (SELECT max(day) AS as_of FROM daily), {_BALANCES}, newest AS (SELECT branch_id, product_id, arg_max(closing_units, day) AS on_hand FROM closing GROUP BY 1, 2), r AS (SELECT branch_id, product_id, avg(requested_units) AS mean, stddev_samp(requested_units) AS sd, sum(lost_units) / greatest(sum(requested_units), 1) AS lost FROM daily, a WHERE day >= as_of - 35 GROUP BY 1, 2)\n" "SELECT branch_id, product_id, on_hand, round(coalesce(mean, 0), 6) AS avg_requested, round(coalesce(sd, 0), 6) AS std_requested, round(coalesce(lost, 0), 6) AS lost_rate, on_hand = 0 AS is_out, on_hand > 0 AND on_hand < coalesce(mean, 0) * 3 AS is_low FROM newest LEFT JOIN r USING (branch_id, product_id)")
def q_inv_stock_context(spark: SparkSession, folder: str) -> DataFrame:
    """The newest balance of each pair with its demand over the last 36 days, and flags."""
    own = ["branch_id", "product_id"]
    daily = _pair_days(spark, folder)
    last = daily.agg(F.max("day").alias("as_of"))  # one row
    recent = daily.join(F.broadcast(last), F.col("day") >= F.date_sub("as_of", 35)).groupBy(*own).agg(F.avg("requested_units").alias("mean"), F.stddev_samp("requested_units").alias("sd"), floored_ratio(F.sum("lost_units"), F.sum("requested_units")).alias("lost"))
    newest = _closing(spark, folder).groupBy(*own).agg(F.max_by("closing_units", "day").alias("on_hand"))
    mean = F.coalesce("mean", F.lit(0.0))
    figures = [F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for c, n in (("mean", "avg_requested"), ("sd", "std_requested"), ("lost", "lost_rate"))]
    return newest.join(recent, own, "left").select(*own, "on_hand", *figures, (F.col("on_hand") == 0).alias("is_out"), ((F.col("on_hand") > 0) & (F.col("on_hand") < mean * 3)).alias("is_low"))


@query(f"WITH {_PAIR_DAYS}, a AS (SELECT max(day) AS as_of FROM daily) SELECT branch_id, product_id, sum(requested_units) FILTER (day > as_of - 7)::BIGINT AS last_7d, sum(requested_units) FILTER (day > as_of - 28)::BIGINT AS last_28d, max(stockout_today) FILTER (day > as_of - 28) AS any_stockout_28d, count(*) AS active_days FROM daily, a GROUP BY 1, 2")
def q_opair_recent_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Recent demand of every branch and product at once, where a service would ask for one at a time."""
    daily = _pair_days(spark, folder)
    last = daily.agg(F.max("day").alias("as_of"))  # one row
    within = lambda days, c: F.when(F.col("day") > F.date_sub("as_of", days), F.col(c))
    return daily.join(F.broadcast(last)).groupBy("branch_id", "product_id").agg(F.sum(within(7, "requested_units")).alias("last_7d"), F.sum(within(28, "requested_units")).alias("last_28d"), F.max(within(28, "stockout_today")).alias("any_stockout_28d"), F.count(F.lit(1)).alias("active_days"))


def register_views(spark: SparkSession, folder: str, prefix: str = "bi") -> list[str]:
    """The star as temporary views: dimensions of branches and products, facts of sales, lines and demand. Nothing is copied."""
    day = lambda c: utc_day(c).alias("business_date")
    views = {
        "dim_branch": table(spark, folder, "pharmacy_branch").select("branch_id", "branch_code", "governorate", "locality_type", "is_24_hours", "checkout_points"),
        "dim_product": table(spark, folder, "master_product").groupBy("product_id").agg(F.min("trade_name_en").alias("trade_name_en"), F.min("drug_class").alias("drug_class"), F.min("route").alias("route")),
        "fact_sale": table(spark, folder, "sale_header").select("sale_id", "branch_id", day("transaction_ts"), "net_sales_egp", "gross_profit_egp", "transaction_status"),
        "fact_line": table(spark, folder, "sale_line").select("sale_line_id", "sale_id", "product_id", day("created_at"), "quantity", "net_sales_egp"),
        "fact_demand": table(spark, folder, "demand_attempt").select("demand_attempt_id", "branch_id", "product_id", day("transaction_ts"), "requested_units", "fulfilled_units", "lost_units", "outcome"),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in views]


@query("""WITH s AS (SELECT branch_id, count(*) AS sales, sum(net_sales_egp) AS net_sales, sum(gross_profit_egp) AS profit FROM sale_header WHERE upper(transaction_status) = 'COMPLETED' GROUP BY 1), d AS (SELECT branch_id, sum(requested_units)::BIGINT AS requested, sum(fulfilled_units)::BIGINT AS fulfilled, count(*) FILTER (outcome = 'OUT_OF_STOCK') AS stockouts FROM demand_attempt GROUP BY 1)
SELECT b.branch_id, b.governorate, coalesce(sales, 0) AS sales, net_sales, CASE WHEN net_sales > 0 THEN round(profit::DOUBLE / net_sales::DOUBLE, 6) END AS margin, coalesce(requested, 0) AS requested, CASE WHEN requested > 0 THEN round(fulfilled / requested, 6) END AS fill_rate, coalesce(stockouts, 0) AS stockouts FROM pharmacy_branch AS b LEFT JOIN s ON s.branch_id = b.branch_id LEFT JOIN d ON d.branch_id = b.branch_id""")
def bi_v2_branch_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of each branch through SQL over the views; each fact is folded before it meets the dimension."""
    prefix = f"bi_{uuid.uuid4().hex[:12]}"
    names = register_views(spark, folder, prefix)
    star = spark.sql(f"""
        WITH s AS (SELECT branch_id, count(*) AS sales, sum(net_sales_egp) AS net_sales, sum(gross_profit_egp) AS profit FROM {prefix}_fact_sale WHERE upper(transaction_status) = 'COMPLETED' GROUP BY branch_id),
             d AS (SELECT branch_id, sum(requested_units) AS requested, sum(fulfilled_units) AS fulfilled, count_if(outcome = 'OUT_OF_STOCK') AS stockouts FROM {prefix}_fact_demand GROUP BY branch_id)
        SELECT branch_id, governorate, coalesce(sales, 0L) AS sales, net_sales, profit, coalesce(requested, 0L) AS requested, fulfilled, coalesce(stockouts, 0L) AS stockouts
        FROM {prefix}_dim_branch LEFT JOIN s USING (branch_id) LEFT JOIN d USING (branch_id)""")
    for name in names:  # they are resolved by now
        spark.catalog.dropTempView(name)
    return star.select("branch_id", "governorate", "sales", "net_sales", rate(F.col("profit"), F.col("net_sales")).alias("margin"), "requested", rate(F.col("fulfilled"), F.col("requested")).alias("fill_rate"), "stockouts")
