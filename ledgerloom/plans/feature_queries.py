"""Feature queries: dense and sparse daily series with lags, windows back and labels ahead; samples; seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import floored_ratio
from ..functions.temporal import utc_day, zoned_moment
from ..operators.sampling import hash_bucket, top_of_each, within_budget
from ..operators.series import ahead, back, dense, forward_filled, strict
from ..registry import query
from ..session import table

_DAY = "(transaction_ts AT TIME ZONE 'UTC')::DATE"
_PRODUCT_DAYS = f"""daily AS (SELECT product_id, {_DAY} AS day, sum(requested_units)::BIGINT AS requested_units, sum(lost_units)::BIGINT AS lost_units, count(*) FILTER (outcome = 'OUT_OF_STOCK')::BIGINT AS stockouts
  FROM demand_attempt WHERE product_id IS NOT NULL AND transaction_ts IS NOT NULL GROUP BY 1, 2)"""
_PAIR_DAYS = f"""daily AS (SELECT branch_id, product_id, {_DAY} AS day, sum(requested_units)::BIGINT AS requested_units, sum(lost_units)::BIGINT AS lost_units, max(CASE WHEN outcome = 'OUT_OF_STOCK' THEN 1 ELSE 0 END)::BIGINT AS stockout_today
  FROM demand_attempt WHERE branch_id IS NOT NULL AND product_id IS NOT NULL AND transaction_ts IS NOT NULL GROUP BY 1, 2, 3)"""
_GRID = f"""{_PRODUCT_DAYS}, grid AS (SELECT product_id, day FROM (SELECT DISTINCT product_id FROM daily), (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM daily)),
series AS (SELECT product_id, day, coalesce(requested_units, 0) AS requested_units, coalesce(lost_units, 0) AS lost_units, coalesce(stockouts, 0) AS stockouts, (day - DATE '1970-01-01')::BIGINT AS n FROM grid LEFT JOIN daily USING (product_id, day))"""


def _product_days(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "demand_attempt").filter("product_id IS NOT NULL AND transaction_ts IS NOT NULL")
    return rows.groupBy("product_id", utc_day("transaction_ts").alias("day")).agg(F.sum("requested_units").alias("requested_units"), F.sum("lost_units").alias("lost_units"), F.count_if(F.col("outcome") == "OUT_OF_STOCK").alias("stockouts"))


def _pair_days(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "demand_attempt").filter("branch_id IS NOT NULL AND product_id IS NOT NULL AND transaction_ts IS NOT NULL")
    return rows.groupBy("branch_id", "product_id", utc_day("transaction_ts").alias("day")).agg(F.sum("requested_units").alias("requested_units"), F.sum("lost_units").alias("lost_units"), F.max(F.when(F.col("outcome") == "OUT_OF_STOCK", 1).otherwise(0)).cast("long").alias("stockout_today"))


@query(f"""WITH {_GRID}, features AS (SELECT product_id, day, requested_units, dayofweek(day)::INT + 1 AS day_of_week, month(day)::INT AS month_of_year,
  lag(requested_units, 1) OVER w AS lag_1, lag(requested_units, 7) OVER w AS lag_7, lag(requested_units, 14) OVER w AS lag_14, lag(requested_units, 28) OVER w AS lag_28,
  avg(requested_units) OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS avg_7,
  avg(requested_units) OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING) AS avg_28,
  stddev_samp(requested_units) OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING) AS stddev_28,
  avg(stockouts) OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS stockout_avg_7,
  sum(requested_units) OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS next_1d,
  sum(requested_units) OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS next_7d,
  sum(requested_units) OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS next_14d,
  sum(requested_units) OVER (PARTITION BY product_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 30 FOLLOWING) AS next_30d
  FROM series WINDOW w AS (PARTITION BY product_id ORDER BY day))
SELECT product_id, day::VARCHAR AS day, requested_units, day_of_week, month_of_year, lag_1, lag_7, lag_14, lag_28, round(avg_7, 6) AS avg_7, round(avg_28, 6) AS avg_28, round(stddev_28, 6) AS stddev_28, round(stockout_avg_7, 6) AS stockout_avg_7,
  next_1d::BIGINT AS next_1d, next_7d::BIGINT AS next_7d, next_14d::BIGINT AS next_14d, next_30d::BIGINT AS next_30d, round(avg_7 / greatest(avg_28, 1.0), 6) AS trend FROM features WHERE lag_28 IS NOT NULL AND next_1d IS NOT NULL""")
def q_dfeat_demand_features(spark: SparkSession, folder: str) -> DataFrame:
    """Demand of each product and day of the calendar with lags, averages before and demand after it."""
    series = dense(_product_days(spark, folder), ["product_id"], "day", ["requested_units", "lost_units", "stockouts"])
    own = ["product_id"]
    rows = Window.partitionBy(*own).orderBy("day")
    r = F.col("requested_units")
    features = series.select(
        "product_id", "day", r, F.dayofweek("day").alias("day_of_week"), F.month("day").alias("month_of_year"), *[F.lag(r, k).over(rows).alias(f"lag_{k}") for k in (1, 7, 14, 28)],
        F.avg(r).over(back(own, "day", 7)).alias("avg_7"), F.avg(r).over(back(own, "day", 28)).alias("avg_28"), F.stddev_samp(r).over(back(own, "day", 28)).alias("stddev_28"), F.avg("stockouts").over(back(own, "day", 7)).alias("stockout_avg_7"),
        *[F.sum(r).over(ahead(own, "day", k)).alias(f"next_{k}d") for k in (1, 7, 14, 30)],
    ).filter("lag_28 IS NOT NULL AND next_1d IS NOT NULL")
    trend = F.round(F.col("avg_7") / F.greatest("avg_28", F.lit(1.0)), 6).alias("trend")
    rounded = {c: F.round(c, 6).alias(c) for c in ("avg_7", "avg_28", "stddev_28", "stockout_avg_7")}
    return features.select(*[rounded.get(c, F.col(c)) for c in features.columns if c != "day"], F.col("day").cast("string").alias("day"), trend)


@query(f"""WITH {_PAIR_DAYS}, f AS (SELECT *, (day - DATE '1970-01-01')::BIGINT AS n FROM daily), g AS (SELECT branch_id, product_id, day, requested_units,
  avg(requested_units) OVER p28 AS avg_28, sum(lost_units) OVER p28 / greatest(sum(requested_units) OVER p28, 1) AS lost_rate_28, avg(stockout_today) OVER p28 AS stockout_rate_28,
  max(stockout_today) OVER (PARTITION BY branch_id, product_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS stockout_next_7d,
  sum(requested_units) OVER (PARTITION BY branch_id, product_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS demand_next_21d
  FROM f WINDOW p28 AS (PARTITION BY branch_id, product_id ORDER BY n RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING))
SELECT branch_id, product_id, day::VARCHAR AS day, requested_units, round(avg_28, 6) AS avg_28, round(lost_rate_28, 6) AS lost_rate_28, round(stockout_rate_28, 6) AS stockout_rate_28, stockout_next_7d, demand_next_21d::BIGINT AS demand_next_21d
FROM g WHERE avg_28 IS NOT NULL AND stockout_next_7d IS NOT NULL AND demand_next_21d IS NOT NULL""")
def q_sfeat_stockout_features(spark: SparkSession, folder: str) -> DataFrame:
    """Days with demand of each branch and product, with figures before and a stock-out label ahead; no grid."""
    own = ["branch_id", "product_id"]
    before = back(own, "day", 28)
    features = _pair_days(spark, folder).select(
        *own, "day", "requested_units", F.avg("requested_units").over(before).alias("avg_28"), floored_ratio(F.sum("lost_units").over(before), F.sum("requested_units").over(before)).alias("lost_rate_28"), F.avg("stockout_today").over(before).alias("stockout_rate_28"),
        F.max("stockout_today").over(ahead(own, "day", 7)).alias("stockout_next_7d"), F.sum("requested_units").over(ahead(own, "day", 21)).alias("demand_next_21d"),
    ).filter("avg_28 IS NOT NULL AND stockout_next_7d IS NOT NULL AND demand_next_21d IS NOT NULL")
    return features.withColumns({"day": F.col("day").cast("string"), **{c: F.round(c, 6) for c in ("avg_28", "lost_rate_28", "stockout_rate_28")}})


@query(f"""WITH {_GRID} SELECT product_id, day::VARCHAR AS day, CASE WHEN count(*) OVER b = 7 THEN round(avg(requested_units) OVER b, 6) END AS full_avg_7,
  CASE WHEN count(*) OVER a = 14 THEN (sum(requested_units) OVER a)::BIGINT END AS full_next_14d FROM series
WINDOW b AS (PARTITION BY product_id ORDER BY n RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY product_id ORDER BY n RANGE BETWEEN 1 FOLLOWING AND 14 FOLLOWING)""")
def wn_16_full_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that count only where all of their days are there."""
    series = dense(_product_days(spark, folder), ["product_id"], "day", ["requested_units"])
    before, after = back(["product_id"], "day", 7), ahead(["product_id"], "day", 14)
    return series.select("product_id", F.col("day").cast("string").alias("day"), strict(F.round(F.avg("requested_units").over(before), 6), before, 7).alias("full_avg_7"), strict(F.sum("requested_units").over(after), after, 14).alias("full_next_14d"))


_BALANCES = """moves AS (SELECT payload->>'$.branch_id' AS branch_id, payload->>'$.product_id' AS product_id, CASE WHEN regexp_matches(occurred_at, '(Z|[+-]\\d\\d:\\d\\d)$') THEN TRY_CAST(occurred_at AS TIMESTAMPTZ) END AS moment,
    TRY_CAST(payload->>'$.on_hand_after' AS BIGINT) AS units, kafka_topic, kafka_partition, kafka_offset
  FROM (SELECT * FROM bronze_event WHERE event_type = 'inventory.quantity_changed' AND json_valid(payload))),
closing AS (SELECT * FROM (SELECT branch_id, product_id, (moment AT TIME ZONE 'UTC')::DATE AS day, units AS closing_units, row_number() OVER (PARTITION BY branch_id, product_id, (moment AT TIME ZONE 'UTC')::DATE
  ORDER BY moment DESC, kafka_topic DESC, kafka_partition DESC, kafka_offset DESC) AS k FROM moves WHERE moment IS NOT NULL AND units IS NOT NULL AND branch_id IS NOT NULL AND product_id IS NOT NULL) WHERE k = 1)"""


def _closing(spark: SparkSession, folder: str) -> DataFrame:
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    moves = table(spark, folder, "bronze_event").filter("event_type = 'inventory.quantity_changed'").select(field("branch_id").alias("branch_id"), field("product_id").alias("product_id"), zoned_moment("occurred_at").alias("moment"), field("on_hand_after").try_cast("long").alias("units"), "kafka_topic", "kafka_partition", "kafka_offset").dropna()
    last = F.max_by("units", F.struct("moment", "kafka_topic", "kafka_partition", "kafka_offset"))
    return moves.groupBy("branch_id", "product_id", utc_day("moment").alias("day")).agg(last.alias("closing_units"))


@query(f"WITH {_BALANCES} SELECT branch_id, product_id, day::VARCHAR AS day, closing_units FROM closing")
def ag_10_closing_balance(spark: SparkSession, folder: str) -> DataFrame:
    """The last balance of each pair and day."""
    return _closing(spark, folder).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {_BALANCES}, {_PAIR_DAYS}, both_days AS (SELECT branch_id, product_id, day, requested_units, closing_units FROM daily LEFT JOIN closing USING (branch_id, product_id, day))
SELECT branch_id, product_id, day::VARCHAR AS day, requested_units, coalesce(last_value(closing_units IGNORE NULLS) OVER (PARTITION BY branch_id, product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS available_units FROM both_days""")
def jn_16_forward_filled_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Demand days with the last balance known by then."""
    own = ["branch_id", "product_id"]
    both = _pair_days(spark, folder).join(_closing(spark, folder), [*own, "day"], "left")
    filled = F.coalesce(forward_filled("closing_units", own, "day"), F.lit(0).cast("long"))
    return both.select(*own, F.col("day").cast("string").alias("day"), "requested_units", filled.alias("available_units"))


@query(f"""WITH {_PAIR_DAYS}, sizes AS (SELECT branch_id, product_id, count(*) AS history, md5(branch_id || '|' || product_id) AS h FROM daily GROUP BY 1, 2),
placed AS (SELECT *, sum(history) OVER (ORDER BY h, branch_id, product_id ROWS UNBOUNDED PRECEDING) AS so_far, row_number() OVER (ORDER BY h, branch_id, product_id) AS k FROM sizes)
SELECT branch_id, product_id, day::VARCHAR AS day, requested_units FROM daily WHERE (branch_id, product_id) IN (SELECT (branch_id, product_id) FROM placed WHERE so_far <= 20000 OR k = 1)""")
def wn_06_row_budget_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Whole histories of pairs in hash order within a budget of 20,000 rows."""
    taken = within_budget(_pair_days(spark, folder), ["branch_id", "product_id"], 20_000, F.concat_ws("|", "branch_id", "product_id"))
    return taken.select("branch_id", "product_id", F.col("day").cast("string").alias("day"), "requested_units")


@query("""SELECT outcome, demand_attempt_id, requested_units FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY md5(demand_attempt_id), demand_attempt_id, created_at) AS k FROM demand_attempt WHERE demand_attempt_id IS NOT NULL) WHERE k <= 50""")
def wn_13_stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty attempts of each outcome, by hash."""
    rows = table(spark, folder, "demand_attempt").filter("demand_attempt_id IS NOT NULL").select("outcome", "demand_attempt_id", "requested_units", "created_at")
    return top_of_each(rows, "outcome", [F.md5("demand_attempt_id"), F.col("demand_attempt_id"), F.col("created_at")], 50).drop("created_at")


@query("SELECT sale_id, branch_id FROM sale_header WHERE sale_id IS NOT NULL AND ('0x' || substr(md5(sale_id), 1, 15))::BIGINT % 100 < 8")
def flt_07_hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sales whose hash falls into 8 of 100 buckets: a sampling operator."""
    return table(spark, folder, "sale_header").filter(hash_bucket(F.col("sale_id"), 100) < 8).select("sale_id", "branch_id")


@query(f"""WITH {_PRODUCT_DAYS}, l AS (SELECT min((created_at AT TIME ZONE 'UTC')::DATE) AS a, max((created_at AT TIME ZONE 'UTC')::DATE) AS b, count(DISTINCT (created_at AT TIME ZONE 'UTC')::DATE) AS c FROM sale_line)
SELECT min(day)::VARCHAR AS demand_first_day, max(day)::VARCHAR AS demand_last_day, count(DISTINCT day) AS demand_days, max(a)::VARCHAR AS sales_first_day, max(b)::VARCHAR AS sales_last_day, max(c) AS sales_days FROM daily, l""")
def q_cov_history_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """First, last and number of days of two sources, as one row."""
    bounds = lambda rows, name: rows.agg(F.min("day").cast("string").alias(f"{name}_first_day"), F.max("day").cast("string").alias(f"{name}_last_day"), F.count_distinct("day").alias(f"{name}_days"))
    sales = table(spark, folder, "sale_line").select(utc_day("created_at").alias("day"))
    # two single rows
    return bounds(_product_days(spark, folder), "demand").join(bounds(sales, "sales"))


@query(f"""WITH {_PAIR_DAYS}, c AS (SELECT count(DISTINCT day) AS days FROM daily) SELECT branch_id, product_id, round(avg(requested_units), 6) AS avg_requested, round(stddev_samp(requested_units), 6) AS std_requested,
  round(sum(lost_units) / greatest(sum(requested_units), 1), 6) AS lost_rate, round(avg(stockout_today), 6) AS stockout_rate, round(count(*) / greatest(max(c.days), 1), 6) AS active_day_rate
FROM daily, c GROUP BY 1, 2 HAVING avg(requested_units) > 0""")
def q_sseed_pair_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Averages, deviation, lost and stock-out rates of each pair, and its share of all days."""
    daily = _pair_days(spark, folder)
    days = daily.agg(F.count_distinct("day").alias("days"))
    stats = daily.groupBy("branch_id", "product_id").agg(
        F.count(F.lit(1)).alias("active"), F.avg("requested_units").alias("mean"), F.round(F.stddev_samp("requested_units"), 6).alias("std_requested"), F.round(floored_ratio(F.sum("lost_units"), F.sum("requested_units")), 6).alias("lost_rate"), F.round(F.avg("stockout_today"), 6).alias("stockout_rate")
    ).filter("mean > 0")
    joined = stats.join(F.broadcast(days))  # one row
    return joined.select("branch_id", "product_id", F.round("mean", 6).alias("avg_requested"), "std_requested", "lost_rate", "stockout_rate", F.round(floored_ratio(F.col("active"), F.col("days")), 6).alias("active_day_rate"))


@query(f"""WITH {_PRODUCT_DAYS}, a AS (SELECT max(day) AS as_of FROM daily), p AS (SELECT product_id, day, requested_units FROM daily, a WHERE day >= as_of - 35)
SELECT product_id, count(*) AS active_days, sum(requested_units)::BIGINT AS requested_units, round(avg(requested_units), 6) AS avg_requested, round(stddev_samp(requested_units), 6) AS std_requested FROM p GROUP BY 1""")
def q_odem_recent_demand(spark: SparkSession, folder: str) -> DataFrame:
    """The last 36 days of each product, counted from the last day of all: for all keys at once."""
    daily = _product_days(spark, folder)
    last = daily.agg(F.max("day").alias("as_of"))  # one row
    recent = daily.join(F.broadcast(last), F.col("day") >= F.date_sub("as_of", 35))
    return recent.groupBy("product_id").agg(F.count(F.lit(1)).alias("active_days"), F.sum("requested_units").alias("requested_units"), F.round(F.avg("requested_units"), 6).alias("avg_requested"), F.round(F.stddev_samp("requested_units"), 6).alias("std_requested"))


@query(f"""WITH {_GRID} SELECT product_id, day::VARCHAR AS day, round(avg(requested_units) OVER (PARTITION BY product_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS avg_7_rows FROM series""")
def wn_11_rows_window(spark: SparkSession, folder: str) -> DataFrame:
    """The average of the seven rows before, on a dense grid the same as of seven days."""
    series = dense(_product_days(spark, folder), ["product_id"], "day", ["requested_units"])
    rows = Window.partitionBy("product_id").orderBy("day").rowsBetween(-7, -1)
    return series.select("product_id", F.col("day").cast("string").alias("day"), F.round(F.avg("requested_units").over(rows), 6).alias("avg_7_rows"))


@query(f"""WITH {_PRODUCT_DAYS} SELECT product_id, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, arg_min(requested_units, day) AS first_units, arg_max(requested_units, day) AS last_units,
  max(requested_units) AS most_units, min(struct_pack(a := -requested_units, d := day)).d::VARCHAR AS day_of_most FROM daily WHERE requested_units IS NOT NULL GROUP BY 1""")
def wn_18_series_ends(spark: SparkSession, folder: str) -> DataFrame:
    """First and last value and the day of the greatest of each series; of equal ones the first."""
    own = F.struct((-F.col("requested_units")).alias("a"), F.col("day").alias("d"))
    known = _product_days(spark, folder).filter("requested_units IS NOT NULL")
    return known.groupBy("product_id").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.min_by("requested_units", "day").alias("first_units"), F.max_by("requested_units", "day").alias("last_units"), F.max("requested_units").alias("most_units"), F.min(own)["d"].cast("string").alias("day_of_most"))


@query(f"""WITH {_PRODUCT_DAYS} SELECT product_id, count(*) AS active_days, round(avg(requested_units), 6) AS avg_requested, round(stddev_samp(requested_units), 6) AS std_requested, round(sum(lost_units) / greatest(sum(requested_units), 1), 6) AS lost_rate
FROM daily GROUP BY 1 HAVING avg(requested_units) IS NOT NULL""")
def q_dseed_product_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Averages, deviation and lost rate of each product's days with demand."""
    stats = _product_days(spark, folder).groupBy("product_id").agg(F.count(F.lit(1)).alias("active_days"), F.avg("requested_units").alias("mean"), F.round(F.stddev_samp("requested_units"), 6).alias("std_requested"), F.round(floored_ratio(F.sum("lost_units"), F.sum("requested_units")), 6).alias("lost_rate"))
    return stats.filter("mean IS NOT NULL").select("product_id", "active_days", F.round("mean", 6).alias("avg_requested"), "std_requested", "lost_rate")
