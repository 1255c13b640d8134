"""Serving queries: daily demand by branch, context, completeness, as-of days, trends, parameterised reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..functions.text import named
from ..functions.temporal import utc_day
from ..registry import query
from ..session import table

#: Fixed value: the zone of the business day.
BUSINESS_ZONE = "Africa/Cairo"
_DAILY = """daily AS (SELECT (transaction_ts AT TIME ZONE 'Africa/Cairo')::DATE AS business_date, branch_id, coalesce(nullif(trim(reason_code), ''), 'UNKNOWN') AS reason, count(*) AS attempts, coalesce(sum(requested_units), 0)::BIGINT AS requested_units,
  coalesce(sum(fulfilled_units), 0)::BIGINT AS fulfilled_units, coalesce(sum(lost_units), 0)::BIGINT AS lost_units, count(*) FILTER (outcome = 'OUT_OF_STOCK') AS stockouts, min(transaction_ts) AS first_at, max(transaction_ts) AS last_at
  FROM demand_attempt WHERE transaction_ts IS NOT NULL GROUP BY 1, 2, 3)"""
_COMPLETE = f"""WITH {_DAILY}, expected AS (SELECT count(*) AS branches FROM pharmacy_branch), observed AS (SELECT business_date, count(DISTINCT branch_id) AS seen, sum(attempts)::BIGINT AS attempts, sum(requested_units)::BIGINT AS requested_units, sum(fulfilled_units)::BIGINT AS fulfilled_units
  FROM daily GROUP BY 1), days AS (SELECT business_date, seen, branches, round(seen / nullif(branches, 0), 6) AS coverage, CASE WHEN branches > 0 AND seen / branches >= 0.5 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status, attempts, requested_units, fulfilled_units FROM observed, expected)"""
#: Share of branches that must have reported, so that a day counts as complete; what the queries ask of the thin test tables.
REQUIRED, THIN = 0.95, 0.5


def business_day(moment: str) -> Column:
    """The calendar day of a moment in the business's zone, whatever the session's zone is."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.to_date(F.from_utc_timestamp(utc, BUSINESS_ZONE))


def branch_daily(attempts: DataFrame) -> DataFrame:
    """Attempts, units and stock-outs by business day, branch and reason; rows without a moment are left out."""
    known = attempts.filter("transaction_ts IS NOT NULL")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return known.groupBy(business_day("transaction_ts").alias("business_date"), "branch_id", named(F.col("reason_code")).alias("reason")).agg(
        F.count(F.lit(1)).alias("attempts"), total("requested_units"), total("fulfilled_units"), total("lost_units"), F.count_if(F.col("outcome") == "OUT_OF_STOCK").alias("stockouts"), F.min("transaction_ts").alias("first_at"), F.max("transaction_ts").alias("last_at")
    )


@query(f"""WITH {_DAILY} SELECT business_date::VARCHAR AS business_date, d.branch_id, branch_code, governorate, reason, attempts, requested_units, fulfilled_units, lost_units, stockouts,
  CASE WHEN requested_units > 0 THEN round(fulfilled_units / requested_units, 6) END AS fill_rate, epoch_us(first_at) AS first_micros, epoch_us(last_at) AS last_micros FROM daily AS d JOIN pharmacy_branch AS b ON b.branch_id = d.branch_id""")
def q_daily_branch_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Daily demand of each branch and reason with its fill rate and the branch's attributes."""
    branches = table(spark, folder, "pharmacy_branch").select("branch_id", "branch_code", "governorate")
    daily = branch_daily(table(spark, folder, "demand_attempt")).join(branches, "branch_id")
    fill = rate(F.col("fulfilled_units"), F.col("requested_units")).alias("fill_rate")
    return daily.select(F.col("business_date").cast("string").alias("business_date"), "branch_id", "branch_code", "governorate", "reason", "attempts", "requested_units", "fulfilled_units", "lost_units", "stockouts", fill, F.unix_micros("first_at").alias("first_micros"), F.unix_micros("last_at").alias("last_micros"))


def completeness(spark: SparkSession, folder: str, required: float = REQUIRED) -> DataFrame:
    """Each day with the share of branches that reported, and whether that makes it complete."""
    expected = table(spark, folder, "pharmacy_branch").agg(F.count(F.lit(1)).alias("branches"))  # one row
    observed = branch_daily(table(spark, folder, "demand_attempt")).groupBy("business_date").agg(F.count_distinct("branch_id").alias("seen"), F.sum("attempts").alias("attempts"), F.sum("requested_units").alias("requested_units"), F.sum("fulfilled_units").alias("fulfilled_units"))
    share = F.try_divide("seen", "branches")
    status = F.when(share >= required, "COMPLETE").otherwise("INCOMPLETE")
    return observed.join(F.broadcast(expected)).select("business_date", "seen", "branches", F.round(share, 6).alias("coverage"), status.alias("status"), "attempts", "requested_units", "fulfilled_units")


@query(f"{_COMPLETE} SELECT * REPLACE (business_date::VARCHAR AS business_date) FROM days")
def q_comp_day_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """The completeness of each business day."""
    return completeness(spark, folder, THIN).withColumn("business_date", F.col("business_date").cast("string"))


@query(f"{_COMPLETE} SELECT max(business_date)::VARCHAR AS as_of FROM days WHERE status = 'COMPLETE'")
def q_asof_last_complete_day(spark: SparkSession, folder: str) -> DataFrame:
    """The last complete day."""
    return completeness(spark, folder, THIN).filter("status = 'COMPLETE'").agg(F.max("business_date").cast("string").alias("as_of"))


@query(f"""{_COMPLETE}, k AS (SELECT * FROM days WHERE status = 'COMPLETE'), a AS (SELECT max(business_date) AS as_of FROM k), w AS (SELECT k.* FROM k, a WHERE business_date BETWEEN as_of - 27 AND as_of)
SELECT count(*) AS days, arg_min(requested_units, business_date) AS first_units, arg_max(requested_units, business_date) AS last_units, arg_max(requested_units, business_date) - arg_min(requested_units, business_date) AS change,
  CASE WHEN arg_min(requested_units, business_date) > 0 THEN round((arg_max(requested_units, business_date) - arg_min(requested_units, business_date)) / arg_min(requested_units, business_date), 6) END AS relative_change,
  round(avg(CASE WHEN requested_units > 0 THEN round(fulfilled_units / requested_units, 6) END), 6) AS average_fill FROM w""")
def q_trend_complete_days(spark: SparkSession, folder: str) -> DataFrame:
    """How demand changed over the complete days of the last 28 up to the last complete one."""
    return _trend(_trend_days(spark, folder)).select("days", "first_units", "last_units", "change", "relative_change", "average_fill")


@query(f"""{_COMPLETE}, k AS (SELECT * FROM days WHERE status = 'COMPLETE'), a AS (SELECT max(business_date) AS as_of FROM k), w AS (SELECT k.*, CASE WHEN requested_units > 0 THEN round(fulfilled_units / requested_units, 6) END AS fill FROM k, a WHERE business_date BETWEEN as_of - 27 AND as_of)
SELECT count(*) AS days, arg_min(requested_units, business_date) AS first_units, arg_max(requested_units, business_date) AS last_units, arg_max(requested_units, business_date) - arg_min(requested_units, business_date) AS change,
  CASE WHEN arg_min(requested_units, business_date) > 0 THEN round((arg_max(requested_units, business_date) - arg_min(requested_units, business_date)) / arg_min(requested_units, business_date), 6) END AS relative_change,
  round(avg(fill), 6) AS average_fill, min(fill) AS least_fill, max(fill) AS greatest_fill,
  min(business_date) FILTER (requested_units = (SELECT min(requested_units) FROM w))::VARCHAR AS least_day, min(requested_units) AS least_units,
  min(business_date) FILTER (requested_units = (SELECT max(requested_units) FROM w))::VARCHAR AS greatest_day, max(requested_units) AS greatest_units FROM w""")
def q_trend_summary(spark: SparkSession, folder: str) -> DataFrame:
    """That change with the days of least and greatest demand, the first of equal ones, and the range of fill rates."""
    return _trend(_trend_days(spark, folder))


def _trend_days(spark: SparkSession, folder: str) -> DataFrame:
    complete = completeness(spark, folder, THIN).filter("status = 'COMPLETE'")
    last = complete.agg(F.max("business_date").alias("as_of"))  # one row
    return complete.join(F.broadcast(last), F.col("business_date").between(F.date_sub("as_of", 27), F.col("as_of")))


def _trend(window: DataFrame) -> DataFrame:
    """One row on the days of ``window``; days without units aren't among the least and greatest."""
    units, day = F.col("requested_units"), F.col("business_date")
    fill = rate(F.col("fulfilled_units"), units)
    place = lambda order: F.when(units.isNotNull(), F.struct(units, order))
    ends = window.agg(
        F.count(F.lit(1)).alias("days"), F.min_by(units, day).alias("first_units"), F.max_by(units, day).alias("last_units"), F.round(F.avg(fill), 6).alias("average_fill"), F.min(fill).alias("least_fill"), F.max(fill).alias("greatest_fill"),
        F.min_by(day, place(day)).cast("string").alias("least_day"), F.min(units).alias("least_units"), F.max_by(day, place(-F.unix_date(day))).cast("string").alias("greatest_day"), F.max(units).alias("greatest_units"),
    )
    change = F.col("last_units") - F.col("first_units")
    return ends.select("days", "first_units", "last_units", change.alias("change"), rate(change, F.col("first_units")).alias("relative_change"), "average_fill", "least_fill", "greatest_fill", "least_day", "least_units", "greatest_day", "greatest_units")


_AGES = ", ".join(f"count(*) FILTER ({w}) AS attempts_{n}, coalesce(sum(requested_units) FILTER ({w}), 0)::BIGINT AS requested_{n}, coalesce(sum(fulfilled_units) FILTER ({w}), 0)::BIGINT AS fulfilled_{n}, count(*) FILTER ({w} AND outcome = 'OUT_OF_STOCK') AS stockouts_{n}" for n, w in (("7d", "transaction_ts >= as_of - INTERVAL 7 DAY"), ("28d", "true")))


@query(f"""WITH a AS (SELECT max(transaction_ts) AS as_of FROM demand_attempt), agg AS (SELECT branch_id, product_id, max(transaction_ts) AS latest, {_AGES} FROM demand_attempt, a WHERE transaction_ts >= as_of - INTERVAL 28 DAY GROUP BY 1, 2),
names AS (SELECT product_id, max(trade_name_en) AS trade_name_en FROM master_product GROUP BY 1)
SELECT g.branch_id, branch_code, g.product_id, trade_name_en, epoch_us(latest) AS latest_micros, attempts_7d, requested_7d, fulfilled_7d, stockouts_7d, CASE WHEN requested_7d > 0 THEN round(fulfilled_7d / requested_7d, 6) END AS fill_7d,
  attempts_28d, requested_28d, fulfilled_28d, stockouts_28d, CASE WHEN requested_28d > 0 THEN round(fulfilled_28d / requested_28d, 6) END AS fill_28d FROM agg AS g JOIN pharmacy_branch AS b ON b.branch_id = g.branch_id LEFT JOIN names AS p ON p.product_id = g.product_id""")
def q_dctx_demand_context(spark: SparkSession, folder: str) -> DataFrame:
    """Demand of each branch and product over 7 and 28 days before the last attempt of all."""
    attempts = table(spark, folder, "demand_attempt")
    last = attempts.agg(F.max("transaction_ts").alias("as_of"))  # one row
    recent = attempts.join(F.broadcast(last), F.col("transaction_ts") >= F.col("as_of") - F.expr("INTERVAL 28 DAYS"))

    def over(name: str, within: Column) -> list[Column]:
        units = lambda c: F.coalesce(F.sum(F.when(within, F.col(c))), F.lit(0))
        return [F.count_if(within).alias(f"attempts_{name}"), units("requested_units").alias(f"requested_{name}"), units("fulfilled_units").alias(f"fulfilled_{name}"), F.count_if(within & (F.col("outcome") == "OUT_OF_STOCK")).alias(f"stockouts_{name}")]

    grouped = recent.groupBy("branch_id", "product_id").agg(F.max("transaction_ts").alias("latest"), *over("7d", F.col("transaction_ts") >= F.col("as_of") - F.expr("INTERVAL 7 DAYS")), *over("28d", F.lit(True)))
    names = table(spark, folder, "master_product").groupBy("product_id").agg(F.max("trade_name_en").alias("trade_name_en"))
    joined = grouped.join(table(spark, folder, "pharmacy_branch").select("branch_id", "branch_code"), "branch_id").join(names, "product_id", "left")
    fills = [rate(F.col(f"fulfilled_{n}"), F.col(f"requested_{n}")).alias(f"fill_{n}") for n in ("7d", "28d")]
    kept = [f"{c}_{n}" for n in ("7d", "28d") for c in ("attempts", "requested", "fulfilled", "stockouts")]
    return joined.select("branch_id", "branch_code", "product_id", "trade_name_en", F.unix_micros("latest").alias("latest_micros"), *kept, *fills)


def matching(rows: DataFrame, order: list[Column], limit: int | None, **wanted: object) -> DataFrame:
    """Rows that match what is asked for: None asks nothing, a list any of its values; ``limit`` is held within 1 and 500."""
    conditions = [F.col(c).isin(*v) if isinstance(v, list | tuple) else F.col(c) == v for c, v in wanted.items() if v is not None]
    found = rows.filter(reduce(lambda a, b: a & b, conditions, F.lit(True))).orderBy(*order)
    return found.limit(max(1, min(500, limit))) if limit is not None else found


@query("""SELECT branch_id, branch_code, locality_type, is_24_hours, checkout_points FROM pharmacy_branch WHERE lower(locality_type) IN ('urban', 'rural') AND checkout_points >= 2
ORDER BY CASE lower(locality_type) WHEN 'urban' THEN 2 WHEN 'rural' THEN 1 ELSE 0 END DESC, is_24_hours DESC NULLS LAST, checkout_points DESC NULLS LAST, branch_code LIMIT 50""")
def flt_06_branches_by_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """A parameterised read: optional filters, an order of its own for a closed list, flags first, a clamped limit (a top-k report)."""
    branches = table(spark, folder, "pharmacy_branch").withColumn("kind", F.lower("locality_type")).filter("checkout_points >= 2")
    rank = F.when(F.col("kind") == "urban", 2).when(F.col("kind") == "rural", 1).otherwise(0)
    order = [rank.desc(), F.col("is_24_hours").desc_nulls_last(), F.col("checkout_points").desc_nulls_last(), F.col("branch_code")]
    return matching(branches, order, 50, kind=["urban", "rural"], governorate=None).select("branch_id", "branch_code", "locality_type", "is_24_hours", "checkout_points")


@query("SELECT count(*) AS runs, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (completed_at IS NULL) AS incomplete, round(avg(epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 3) AS average_seconds FROM ingestion_run")
def q_sum_run_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of runs in one pass, and their average duration."""
    of = lambda s: F.count_if(F.col("status") == s)
    seconds = F.round(F.avg(F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6, 3)
    return table(spark, folder, "ingestion_run").agg(F.count(F.lit(1)).alias("runs"), of("PASS").alias("passed"), of("FAIL").alias("failed"), of("RUNNING").alias("running"), F.count_if(F.col("completed_at").isNull()).alias("incomplete"), seconds.alias("average_seconds"))


@query("SELECT stage, source_label, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY stage, source_label ORDER BY started_at DESC NULLS LAST, run_id DESC) AS k FROM ingestion_run) WHERE k = 1")
def wn_04_newest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run of each stage and source: one row per key without a window."""
    newest = F.max(F.struct(F.col("started_at").isNotNull(), "started_at", "run_id", "status")).alias("m")
    return table(spark, folder, "ingestion_run").groupBy("stage", "source_label").agg(newest).select("stage", "source_label", "m.run_id", "m.status")


@query("""SELECT b.branch_id, s.sale_id, epoch_us(s.transaction_ts) AS sale_micros FROM pharmacy_branch AS b LEFT JOIN LATERAL (SELECT sale_id, transaction_ts FROM sale_header AS h WHERE h.branch_id = b.branch_id AND h.transaction_ts IS NOT NULL
ORDER BY transaction_ts DESC, sale_id DESC LIMIT 1) AS s ON true""")
def jn_09_newest_sale_of_branch(spark: SparkSession, folder: str) -> DataFrame:
    """Each branch with its newest sale: a lateral top row, as a maximum that merges on the map side."""
    newest = table(spark, folder, "sale_header").filter("transaction_ts IS NOT NULL").groupBy("branch_id").agg(F.max(F.struct("transaction_ts", "sale_id")).alias("m"))
    return table(spark, folder, "pharmacy_branch").select("branch_id").join(newest, "branch_id", "left").select("branch_id", "m.sale_id", F.unix_micros("m.transaction_ts").alias("sale_micros"))


@query("""WITH d AS (SELECT DISTINCT branch_id, terminal_id FROM sale_header WHERE branch_id IS NOT NULL AND terminal_id IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY terminal_id) - 1 AS k, count(*) OVER (PARTITION BY branch_id) AS n FROM d)
SELECT branch_id, terminal_id, n AS terminals FROM t WHERE k = ('0x' || substr(md5(branch_id), 1, 8))::BIGINT % n""")
def jn_10_kth_terminal(spark: SparkSession, folder: str) -> DataFrame:
    """The k-th terminal of each branch in order, k from the branch's hash."""
    terminals = table(spark, folder, "sale_header").select("branch_id", "terminal_id").dropna().distinct()
    of = Window.partitionBy("branch_id")
    placed = terminals.withColumns({"k": F.row_number().over(of.orderBy("terminal_id")) - 1, "terminals": F.count(F.lit(1)).over(of)})
    return placed.filter(F.col("k") == F.conv(F.substring(F.md5("branch_id"), 1, 8), 16, 10).cast("long") % F.col("terminals")).select("branch_id", "terminal_id", "terminals")


@query("""WITH days AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM (SELECT (transaction_ts AT TIME ZONE 'UTC')::DATE AS d FROM demand_attempt))
SELECT d::VARCHAR AS day, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month, day(d)::INT AS day_of_month, dayofweek(d)::INT + 1 AS day_of_week, strftime(d, '%B') AS month_name, strftime(d, '%A') AS day_name, strftime(d, '%Y-%m') AS year_month,
  strftime(d, '%U')::INT AS sunday_week, dayofweek(d) IN (0, 6) AS is_weekend FROM days""")
def bi_v1_dim_date(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar of demand: parts of the date, names, Sunday-based weeks from 0, weekends."""
    bounds = table(spark, folder, "demand_attempt").select(utc_day("transaction_ts").alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("d"))
    sunday_week = F.floor((F.dayofyear("d") + 7 - F.dayofweek("d")) / 7).cast("int")
    return days.select(F.col("d").cast("string").alias("day"), F.year("d").alias("year"), F.quarter("d").alias("quarter"), F.month("d").alias("month"), F.dayofmonth("d").alias("day_of_month"), F.dayofweek("d").alias("day_of_week"), F.date_format("d", "MMMM").alias("month_name"), F.date_format("d", "EEEE").alias("day_name"), F.date_format("d", "yyyy-MM").alias("year_month"), sunday_week.alias("sunday_week"), F.dayofweek("d").isin(1, 7).alias("is_weekend"))
