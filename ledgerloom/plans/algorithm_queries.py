"""Allocation, apportionment, evaluation and splits over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import utc_day
from ..operators.allocation import from_lots, largest_remainder
from ..operators.evaluation import binary_metrics, chosen_threshold, exact_metrics, exact_points, operating_points, regression_metrics, score_table, time_split
from ..registry import query
from ..session import table

_LOTS = """requests AS (SELECT product_id, demand_attempt_id AS request_id, min(transaction_ts) AS ts, min(requested_units)::BIGINT AS units FROM demand_attempt WHERE product_id IS NOT NULL AND demand_attempt_id IS NOT NULL AND transaction_ts IS NOT NULL AND requested_units > 0 GROUP BY 1, 2),
lots AS (SELECT product_id, price_observation_id AS lot_id, observed_at, (5 + ('0x' || substr(md5(price_observation_id), 1, 4))::BIGINT % 40)::BIGINT AS units FROM product_price_history WHERE observed_at IS NOT NULL AND product_id IS NOT NULL),
r AS (SELECT *, sum(units) OVER (PARTITION BY product_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS until FROM requests), l AS (SELECT *, sum(units) OVER (PARTITION BY product_id ORDER BY observed_at, lot_id ROWS UNBOUNDED PRECEDING) AS until FROM lots)"""


@query(f"WITH {_LOTS} SELECT r.product_id, r.request_id, l.lot_id, (least(r.until, l.until) - greatest(r.until - r.units, l.until - l.units))::BIGINT AS units FROM r JOIN l ON r.product_id = l.product_id AND r.until - r.units < l.until AND l.until - l.units < r.until")
def alg_01_requests_from_lots(spark: SparkSession, folder: str) -> DataFrame:
    """Demand in order of time served from lots in order of date (lots made from price observations), first lot first."""
    asked = table(spark, folder, "demand_attempt").filter("product_id IS NOT NULL AND demand_attempt_id IS NOT NULL AND transaction_ts IS NOT NULL AND requested_units > 0")
    requests = asked.groupBy("product_id", F.col("demand_attempt_id").alias("request_id")).agg(F.min("transaction_ts").alias("ts"), F.min("requested_units").cast("long").alias("asked"))
    units = 5 + F.conv(F.substring(F.md5("price_observation_id"), 1, 4), 16, 10).cast("long") % 40
    lots = table(spark, folder, "product_price_history").filter("observed_at IS NOT NULL AND product_id IS NOT NULL").select("product_id", F.col("price_observation_id").alias("lot_id"), "observed_at", units.alias("held"))
    return from_lots(requests, lots, ["product_id"], ["ts"], ["observed_at"], "request_id", "lot_id", "asked", "held")


@query("""WITH w AS (SELECT governorate, branch_id, greatest(coalesce(demand_index::DOUBLE, 0), 0) AS w FROM pharmacy_branch), raw AS (SELECT *, (1000 - 2 * count(*) OVER g) * w / sum(w) OVER g AS raw, count(*) OVER g AS n FROM w WINDOW g AS (PARTITION BY governorate)),
f AS (SELECT *, floor(raw) AS fl, row_number() OVER (PARTITION BY governorate ORDER BY raw - floor(raw) DESC, branch_id DESC) AS k, 1000 - 2 * n - sum(floor(raw)) OVER (PARTITION BY governorate) AS rest FROM raw) SELECT governorate, branch_id, (2 + fl + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS share FROM f""")
def alg_11_largest_remainder(spark: SparkSession, folder: str) -> DataFrame:
    """A thousand shares of each governorate over its branches by demand index, two at least."""
    branches = table(spark, folder, "pharmacy_branch")
    return largest_remainder(branches, "branch_id", "demand_index", 1000, 2, ["governorate"])


_DAYS = "d AS (SELECT product_id, (transaction_ts AT TIME ZONE 'UTC')::DATE AS day, sum(requested_units)::DOUBLE AS y FROM demand_attempt WHERE product_id IS NOT NULL AND transaction_ts IS NOT NULL AND requested_units IS NOT NULL GROUP BY 1, 2), m AS (SELECT product_id, avg(y) AS p FROM d GROUP BY 1), e AS (SELECT product_id, day, y, round(p, 6) AS p, abs(y - round(p, 6)) AS err FROM d JOIN m USING (product_id))"


def _forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Daily demand beside its product's average."""
    known = table(spark, folder, "demand_attempt").filter("product_id IS NOT NULL AND transaction_ts IS NOT NULL AND requested_units IS NOT NULL")
    daily = known.groupBy("product_id", utc_day("transaction_ts").alias("day")).agg(F.sum("requested_units").cast("double").alias("y"))
    means = daily.groupBy("product_id").agg(F.round(F.avg("y"), 6).alias("p"))
    return daily.join(means, "product_id")


@query(f"WITH {_DAYS} SELECT count(*) AS n, round(avg(err), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse, round(1 - sum(err * err) / (var_pop(y) * count(*)), 6) AS r2, round(sum(err) / greatest(sum(abs(y)), 1), 6) AS wape, round(avg(2 * err / greatest(abs(y) + abs(p), 1e-9)), 6) AS smape, round(median(err), 6) AS median_error, round(quantile_cont(err, 0.9), 6) AS p90_error, round(avg(p - y), 6) + 0.0 AS bias FROM e")
def alg_20_regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of each product's average as a forecast of its days."""
    return regression_metrics(_forecasts(spark, folder), "y", "p")


@query(f"""WITH {_DAYS}, u AS (SELECT DISTINCT day FROM d), b AS (SELECT list_sort(list(day)) AS a, count(*) AS n FROM u), c AS (SELECT a[greatest(1, floor(n * 0.6))::INT] AS t, a[greatest(greatest(1, floor(n * 0.6)) + 1, floor(n * 0.8))::INT] AS v FROM b)
SELECT part, count(*) AS rows, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM (SELECT day, CASE WHEN day > v THEN 'test' WHEN day > t AND day <= v - 7 THEN 'validation' WHEN day <= t - 7 THEN 'train' ELSE 'purged' END AS part FROM d, c) GROUP BY 1""")
def alg_19_time_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each part of a split in time with an embargo of seven days."""
    parts = time_split(_forecasts(spark, folder), "day", 7)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


_SCORES = """s AS (SELECT round(least(1, requested_units / 20.0) * 1000)::INT AS level, count(*) AS n, sum(CASE WHEN outcome = 'OUT_OF_STOCK' THEN 1 ELSE 0 END)::BIGINT AS pos FROM demand_attempt WHERE requested_units IS NOT NULL GROUP BY 1),
r AS (SELECT *, sum(n) OVER w AS taken, sum(pos) OVER w AS hits, sum(n) OVER () AS rows, sum(pos) OVER () AS allpos, level / 1000.0 AS score FROM s WINDOW w AS (ORDER BY level DESC ROWS UNBOUNDED PRECEDING))"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    attempts = table(spark, folder, "demand_attempt").filter("requested_units IS NOT NULL")
    return score_table(attempts.select((F.col("outcome") == "OUT_OF_STOCK").cast("int").alias("truth"), F.least(F.lit(1.0), F.col("requested_units") / 20.0).alias("score")).fillna(0, ["truth"]), "truth", "score")


@query(f"""WITH {_SCORES}, b AS (SELECT least(floor(score * 10), 9) AS bin, sum(n) AS n, abs(sum(score * n) - sum(pos)) AS gap FROM s2 GROUP BY 1), g AS (SELECT round(sum(gap) / sum(n), 6) AS calibration_error FROM b)
SELECT round(sum(pos) / sum(n), 6) AS prevalence, round(sum(pos * ((rows - allpos) - (taken - hits) + (n - pos) * 0.5)) / max(allpos * (rows - allpos)), 6) AS roc_auc, round(sum(pos / allpos * hits / taken), 6) AS average_precision, round(sum(pos * (1 - score) * (1 - score) + (n - pos) * score * score) / sum(n), 6) AS brier, max(calibration_error) AS calibration_error FROM r, g""".replace("FROM s2", "FROM (SELECT *, level / 1000.0 AS score FROM s)"))
def alg_22_binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """How well the units asked for tell a stock-out, from counts by score."""
    return binary_metrics(_scores(spark, folder))


@query(f"WITH {_SCORES} SELECT level, round(hits / taken, 6) AS precision, round(hits / allpos, 6) AS recall, round(taken / rows, 6) AS alert_rate, round(5.0 * (hits / taken) * (hits / allpos) / (4.0 * (hits / taken) + hits / allpos), 6) AS f2 FROM r")
def alg_23_operating_points(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall, alert rate and F2 at each score."""
    return operating_points(_scores(spark, folder))


_FINE = """fine AS (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, requested_units / (requested_units + 7.0::DOUBLE) / 1000)) AS score, count(*) AS n, sum(CASE WHEN outcome = 'OUT_OF_STOCK' THEN 1 ELSE 0 END) AS pos FROM demand_attempt WHERE requested_units > 0 GROUP BY 1),
f AS (SELECT *, sum(n) OVER w AS taken, sum(pos) OVER w AS hits, sum(n) OVER () AS rows, sum(pos) OVER () AS allpos FROM fine WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, hits / taken AS precision, hits / allpos AS recall, taken / rows AS alert_rate, greatest(allpos / rows, 1e-9) AS prevalence, greatest(1, floor(rows / 10)) AS top FROM f)"""


def _fine_points(spark: SparkSession, folder: str) -> DataFrame:
    """Scores below 0.001, as those of rare events."""
    asked = F.col("requested_units").cast("double")
    attempts = table(spark, folder, "demand_attempt").filter("requested_units > 0")
    return exact_points(attempts.select((F.col("outcome") == "OUT_OF_STOCK").cast("int").alias("truth"), (asked / (asked + 7.0) / 1000).alias("score")).fillna(0, ["truth"]), "truth", "score")


@query(f"""WITH {_FINE}, b AS (SELECT sum(n) AS n, abs(sum(score * n) - sum(pos)) AS gap FROM g GROUP BY least(floor(score * 10), 9)), c AS (SELECT round(sum(gap) / sum(n), 6) AS calibration_error FROM b),
t AS (SELECT *, pos * greatest(0, least(1, (top - (taken - n)) / n)) AS in_top FROM g)
SELECT sum(n)::BIGINT AS scored, round(sum(pos) / sum(n), 6) AS prevalence, round(sum(pos * ((rows - allpos) - (taken - hits) + (n - pos) * 0.5)) / max(allpos * (rows - allpos)), 6) AS roc_auc, round(sum(pos / allpos * precision), 6) AS average_precision,
  round(sum(pos / allpos * precision) / max(prevalence), 6) AS average_precision_lift, round(sum(pos * (1 - score) * (1 - score) + (n - pos) * score * score) / sum(n), 6) AS brier, round(sum(in_top) / max(top), 6) AS top_precision, round(sum(in_top) / max(allpos), 6) AS top_recall,
  round(sum(in_top) / max(top) / max(prevalence), 6) AS top_lift, max(calibration_error) AS calibration_error FROM t, c""")
def alg_22_exact_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """How well very small scores tell a stock-out, each for itself, with the lifts of average precision and the top tenth."""
    return exact_metrics(_fine_points(spark, folder))


@query(f"""WITH {_FINE}, h AS (SELECT *, precision / prevalence AS lift, CASE WHEN recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2, CASE WHEN prevalence < 0.005 THEN 5 WHEN prevalence < 0.02 THEN 3 ELSE 1.5 END AS needed FROM g),
best AS (SELECT score FROM h WHERE recall >= 0.5 AND lift >= needed AND alert_rate <= 0.1 ORDER BY f2 DESC, lift DESC, alert_rate LIMIT 1),
tenth AS (SELECT quantile_cont(greatest(0.0::DOUBLE, least(1.0::DOUBLE, requested_units / (requested_units + 7.0::DOUBLE) / 1000)), 0.9) AS score FROM demand_attempt WHERE requested_units > 0),
chosen AS (SELECT coalesce((SELECT score FROM best), score) AS threshold, CASE WHEN (SELECT score FROM best) IS NULL THEN 'top_tenth' ELSE 'operating_point' END AS selection FROM tenth)
SELECT selection, round(threshold, 9) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(alert_rate, 6) AS alert_rate, round(lift, 6) AS lift, round(f2, 6) AS f2 FROM h, chosen WHERE score >= threshold ORDER BY score LIMIT 1""")
def alg_23_chosen_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The score from which on to expect a stock-out, chosen for a rare event."""
    return chosen_threshold(_fine_points(spark, folder))
