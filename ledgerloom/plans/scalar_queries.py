"""Scalar rules on whole columns: texts, hashes, days, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import hash_unit, hash_unit_sha
from ..functions.numbers import finite, half_up, logistic, normal_cdf
from ..functions.text import blank, match_key, named, tidy
from ..functions.temporal import compact_date, utc_day
from ..operators.catalogue import first_of_key, normalised
from ..registry import query
from ..session import table
from .serving_queries import business_day

_WHITE = r"[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b]"
_TIDY = "trim(regexp_replace({0}, '" + _WHITE.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"


@query(f"SELECT product_id, source_snapshot_label, {_TIDY.format('trade_name_en')} AS tidy_name, lower({_TIDY.format('manufacturer')}) AS maker_key, coalesce(nullif(regexp_replace(drug_class, '^{_WHITE}+|{_WHITE}+$', '', 'g'), ''), 'UNKNOWN') AS drug_class, manufacturer IS NULL OR regexp_full_match(manufacturer, '{_WHITE}*') AS no_maker FROM master_product")
def str_04_tidy_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Names with single spaces, makers as keys, classes with a default, blanks found."""
    return table(spark, folder, "master_product").select("product_id", "source_snapshot_label", tidy(F.col("trade_name_en")).alias("tidy_name"), match_key(F.col("manufacturer")).alias("maker_key"), named(F.col("drug_class")).alias("drug_class"), blank(F.col("manufacturer")).alias("no_maker"))


@query("""SELECT branch_id, concat_ws('|', branch_code, governorate_code, locality_type) AS joined, branch_code || '-' || lpad(checkout_points::VARCHAR, 4, '0') AS padded, substr(branch_code, 4) AS tail, branch_code LIKE 'BR-00%' AS low, contains(lower(display_name), 'pharm') AS says_pharmacy,
  upper(coalesce(locality_type, '')) NOT IN ('RURAL', '') AS not_rural FROM pharmacy_branch""")
def str_08_text_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Joining, padding, cutting, prefixes, membership, normalised exclusion."""
    return table(spark, folder, "pharmacy_branch").select(
        "branch_id", F.concat_ws("|", "branch_code", "governorate_code", "locality_type").alias("joined"), F.concat("branch_code", F.lit("-"), F.lpad(F.col("checkout_points").cast("string"), 4, "0")).alias("padded"), F.expr("substring(branch_code, 4)").alias("tail"),
        F.col("branch_code").like("BR-00%").alias("low"), F.lower("display_name").contains("pharm").alias("says_pharmacy"), (~F.upper(F.coalesce("locality_type", F.lit(""))).isin("RURAL", "")).alias("not_rural"),
    )


@query("""SELECT sale_id, round(('0x' || substr(md5(sale_id), 1, 8))::BIGINT / 4294967295.0, 9) AS unit_md5, round((('0x' || substr(sha256(sale_id), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551615.0, 9) AS unit_sha, substr(sha256(sale_id), 1, 20) AS batch_name FROM (SELECT DISTINCT sale_id FROM sale_header WHERE sale_id IS NOT NULL)""")
def hash_01_hash_units(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers between 0 and 1 from MD5 and SHA-256, and a short name."""
    ids = table(spark, folder, "sale_header").select("sale_id").filter("sale_id IS NOT NULL").distinct()
    return ids.select("sale_id", F.round(hash_unit(F.col("sale_id")), 9).alias("unit_md5"), F.round(hash_unit_sha(F.col("sale_id")), 9).alias("unit_sha"), F.substring(F.sha2("sale_id", 256), 1, 20).alias("batch_name"))


@query("""WITH d AS (SELECT sale_id, transaction_ts, created_at, (transaction_ts AT TIME ZONE 'UTC')::DATE AS day, (transaction_ts AT TIME ZONE 'Africa/Cairo')::DATE AS local_day FROM sale_header WHERE transaction_ts IS NOT NULL)
SELECT sale_id, day::VARCHAR AS day, local_day::VARCHAR AS local_day, date_diff('day', day, (created_at AT TIME ZONE 'UTC')::DATE) AS days_to_creation, dayofweek(day)::INT + 1 AS day_of_week, isodow(day)::INT AS iso_day, month(day)::INT AS month, (day - DATE '1970-01-01')::BIGINT AS unix_day, (day + 30)::VARCHAR AS due,
  epoch_us(transaction_ts + INTERVAL 36 HOUR) AS plus_36h, dayofweek(day) IN (0, 6) AS is_weekend, hour(transaction_ts AT TIME ZONE 'UTC') >= 22 OR hour(transaction_ts AT TIME ZONE 'UTC') < 6 AS open_overnight FROM d""")
def dt_01_day_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Days in two zones, differences, weekday numbers, unix days, intervals, opening hours over midnight."""
    day = utc_day("transaction_ts")
    hour = F.floor(F.pmod(F.unix_micros("transaction_ts"), F.lit(86_400_000_000)) / 3_600_000_000)
    sales = table(spark, folder, "sale_header").filter("transaction_ts IS NOT NULL")
    return sales.select(
        "sale_id", day.cast("string").alias("day"), business_day("transaction_ts").cast("string").alias("local_day"), F.datediff(utc_day("created_at"), day).cast("long").alias("days_to_creation"), F.dayofweek(day).alias("day_of_week"), (F.weekday(day) + 1).alias("iso_day"), F.month(day).alias("month"), F.unix_date(day).cast("long").alias("unix_day"),
        F.date_add(day, 30).cast("string").alias("due"), F.unix_micros(F.col("transaction_ts") + F.expr("INTERVAL 36 HOURS")).alias("plus_36h"), F.dayofweek(day).isin(1, 7).alias("is_weekend"), ((hour >= 22) | (hour < 6)).alias("open_overnight"),
    )


_ERF = "(1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))"


@query(f"""WITH z AS (SELECT product_id, avg(requested_units) AS m, coalesce(stddev_samp(requested_units), 0) AS s, sum(lost_units)::DOUBLE AS lost FROM demand_attempt WHERE product_id IS NOT NULL GROUP BY 1), v AS (SELECT *, (m - 5) / greatest(s, 1) AS q FROM z), w AS (SELECT *, abs(q) / sqrt(2) AS x, 1 / (1 + 0.3275911 * (abs(q) / sqrt(2))) AS t FROM v)
SELECT product_id, round(sqrt(m), 6) AS root, round(1 / (1 + exp(-q)), 6) AS logistic, round(0.5 * (1 + sign(q) * {_ERF}), 6) AS normal_cdf, greatest(ceil(m), 3)::BIGINT AS at_least_3, floor(m)::BIGINT AS floored, round(power(m, 1.5), 4) AS powered, CASE WHEN s = 0 THEN 0.0 ELSE round(lost / s, 6) END AS lost_per_deviation FROM w""")
def math_01_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Roots, logistic and normal functions, floors, powers, and 0 for what isn't finite."""
    stats = table(spark, folder, "demand_attempt").filter("product_id IS NOT NULL").groupBy("product_id").agg(F.avg("requested_units").alias("m"), F.coalesce(F.stddev_samp("requested_units"), F.lit(0.0)).alias("s"), F.sum("lost_units").cast("double").alias("lost"))
    q = (F.col("m") - 5) / F.greatest("s", F.lit(1.0))
    return stats.select("product_id", F.round(F.sqrt("m"), 6).alias("root"), F.round(logistic(q), 6).alias("logistic"), F.round(normal_cdf(q), 6).alias("normal_cdf"), F.greatest(F.ceil("m"), F.lit(3).cast("long")).alias("at_least_3"), F.floor("m").alias("floored"), F.round(F.pow("m", F.lit(1.5)), 4).alias("powered"), F.round(finite(F.try_divide("lost", "s")), 6).alias("lost_per_deviation"))


@query("SELECT sale_line_id, round(gross_sales_egp * discount_pct, 2)::DECIMAL(18, 2) AS discount, round(gross_margin_pct, 4)::DECIMAL(10, 4) AS margin FROM (SELECT DISTINCT sale_line_id, gross_sales_egp, discount_pct, gross_margin_pct FROM sale_line)")
def math_04_half_up(spark: SparkSession, folder: str) -> DataFrame:
    """Money to two and rates to four places, half away from zero."""
    lines = table(spark, folder, "sale_line").select("sale_line_id", "gross_sales_egp", "discount_pct", "gross_margin_pct").distinct()
    return lines.select("sale_line_id", half_up(F.col("gross_sales_egp") * F.col("discount_pct"), 2).cast("decimal(18,2)").alias("discount"), half_up(F.col("gross_margin_pct"), 4).cast("decimal(10,4)").alias("margin"))


@query("""WITH d AS (SELECT observed_at, (observed_at AT TIME ZONE 'UTC')::DATE AS day, DATE '2025-06-30' - (observed_at AT TIME ZONE 'UTC')::DATE AS age FROM product_price_history WHERE observed_at IS NOT NULL)
SELECT CASE WHEN age <= 30 THEN '00_30' WHEN age <= 60 THEN '31_60' WHEN age <= 90 THEN '61_90' WHEN age <= 180 THEN '91_180' WHEN age <= 365 THEN '181_365' ELSE '366_plus' END AS bucket, count(*) AS observations, min(day)::VARCHAR AS first_day FROM d GROUP BY 1""")
def case_01_age_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Price observations by age at a day, in a ladder of buckets."""
    day = utc_day("observed_at")
    age = F.datediff(F.lit("2025-06-30").cast("date"), day)
    bucket = F.lit("366_plus")
    for most, name in ((365, "181_365"), (180, "91_180"), (90, "61_90"), (60, "31_60"), (30, "00_30")):
        bucket = F.when(age <= most, name).otherwise(bucket)
    return table(spark, folder, "product_price_history").filter("observed_at IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("observations"), F.min(day).cast("string").alias("first_day"))


@query("""SELECT run_id, count(v) AS inputs, count(*) AS exploded, sum(try_cast(v AS BIGINT))::BIGINT AS counted FROM (SELECT run_id, unnest(CASE WHEN len(a) > 0 THEN a ELSE [NULL] END) AS v FROM (SELECT run_id, regexp_extract_all(input_row_counts, '"[a-z_]+"\\s*:\\s*(\\d+)', 1) AS a FROM ingestion_run)) GROUP BY 1""")
def arr_01_exploded_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts in each run's text as rows, a run without any as one row, folded again."""
    runs = table(spark, folder, "ingestion_run")
    counts = runs.select("run_id", F.explode_outer(F.regexp_extract_all("input_row_counts", F.lit(r'"[a-z_]+"\s*:\s*(\d+)'), 1)).alias("v"))
    return counts.groupBy("run_id").agg(F.count("v").alias("inputs"), F.count(F.lit(1)).alias("exploded"), F.sum(F.col("v").try_cast("long")).alias("counted"))


_FILLER = "('', '.', '-', 'N/A', 'NA', 'NONE', 'UNKNOWN', 'NULL', '?')"


@query(f"""WITH t AS (SELECT *, {_TIDY.format('trade_name_en')} AS name, {_TIDY.format('manufacturer')} AS maker, {_TIDY.format('route')} AS r FROM master_product), n AS (SELECT *, CASE WHEN r IS NULL OR upper(r) IN {_FILLER} THEN 'UNKNOWN' ELSE upper(r) END AS clean_route,
  lower(coalesce(name, '')) || '|' || lower(coalesce(maker, '')) AS match_key, CASE WHEN name IS NULL OR name = '' THEN 'no_name' WHEN maker IS NULL OR maker = '' THEN 'no_maker' WHEN retail_price_egp IS NULL OR retail_price_egp <= 0 THEN 'no_price' END AS reject_reason FROM t)
SELECT match_key, name, maker, clean_route AS route, copies FROM (SELECT *, count(*) OVER (PARTITION BY match_key) AS copies, row_number() OVER (PARTITION BY match_key ORDER BY source_snapshot_label, source_record_number, product_id) AS k FROM n WHERE reject_reason IS NULL) WHERE k = 1""")
def alg_18_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue records normalised, rejected ones left out, the first of each key kept."""
    records = normalised(table(spark, folder, "master_product"), "trade_name_en", "manufacturer", "route", "retail_price_egp")
    return first_of_key(records.filter("reject_reason IS NULL"), "match_key", ["source_snapshot_label", "source_record_number", "product_id"], ["name", "maker", "route"])


@query(f"""WITH t AS (SELECT {_TIDY.format('trade_name_en')} AS name, {_TIDY.format('manufacturer')} AS maker, retail_price_egp FROM master_product) SELECT coalesce(CASE WHEN name IS NULL OR name = '' THEN 'no_name' WHEN maker IS NULL OR maker = '' THEN 'no_maker' WHEN retail_price_egp IS NULL OR retail_price_egp <= 0 THEN 'no_price' END, 'accepted') AS outcome, count(*) AS records FROM t GROUP BY 1""")
def alg_18_reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue records by the reason for which they are rejected."""
    records = normalised(table(spark, folder, "master_product"), "trade_name_en", "manufacturer", "route", "retail_price_egp")
    return records.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT sale_id, notation, (created_at AT TIME ZONE 'UTC')::DATE::VARCHAR AS day FROM (SELECT DISTINCT sale_id, created_at FROM sale_header WHERE sale_id IS NOT NULL AND created_at IS NOT NULL), (VALUES ('yyyyMMdd'), ('yyyy-MM-dd'), ('MM/dd/yyyy')) AS v(notation)
UNION ALL SELECT sale_id, 'none', NULL FROM (SELECT DISTINCT sale_id, created_at FROM sale_header WHERE sale_id IS NOT NULL AND created_at IS NOT NULL)""")
def dt_10_compact_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Creation days written in three notations, and one that isn't any, read again."""
    sales = table(spark, folder, "sale_header").filter("sale_id IS NOT NULL AND created_at IS NOT NULL").select("sale_id", "created_at").distinct().withColumn("day", utc_day("created_at"))
    notations = ("yyyyMMdd", "yyyy-MM-dd", "MM/dd/yyyy")
    written = [F.struct(F.lit(n).alias("notation"), F.date_format("day", n).alias("text")) for n in notations] + [F.struct(F.lit("none").alias("notation"), F.lit("13/45/2025").alias("text"))]
    return sales.select("sale_id", F.explode(F.array(*written)).alias("w")).select("sale_id", "w.notation", compact_date(F.col("w.text")).cast("string").alias("day"))
