"""Queries that read and write in the ways of the sources and sinks, in the shared folder, and give what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.temporal import utc_day, zoned_moment
from ..operators.events import meaning_hash, validated
from ..registry import query
from ..session import delete_at_end, shared_folder, table
from ..sources import readers, sinks
from ..sources.offsets import bounded
from ..streaming.bronze import drain, from_files
from ..streaming.cooldown import alerts
from ..streaming.ledger import against_ledger
from ..streaming.refresh import refresh
from .event_queries import _READ, _VALIDATED
from .serving_queries import branch_daily, business_day


def _own_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it goes when the application ends, as results are read from it until then."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    return f"{folder}/data"


@query("SELECT kafka_topic, kafka_partition, kafka_offset FROM bronze_event WHERE kafka_partition IN (0, 1) AND kafka_offset >= 200 AND kafka_offset < 100000 + 100 * kafka_partition")
def src_02_bounded_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a range of offsets per partition."""
    records = table(spark, folder, "bronze_event")
    topics = [r[0] for r in records.select("kafka_topic").distinct().collect()]  # a handful of topics
    start = {t: {"0": 200, "1": 200} for t in topics}
    end = {t: {"0": 100_000, "1": 100_100} for t in topics}
    return bounded(records, start, end).select("kafka_topic", "kafka_partition", "kafka_offset")


@query("SELECT part, count(*) AS rows FROM (SELECT ('0x' || substr(md5(sale_line_id), 1, 8))::BIGINT % 12 AS part FROM sale_line WHERE sale_line_id IS NOT NULL) GROUP BY 1")
def src_03_hash_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each part of a parallel read by the key's hash."""
    return readers.hash_parts(table(spark, folder, "sale_line").filter("sale_line_id IS NOT NULL"), ["sale_line_id"], 12).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {_VALIDATED} SELECT ((occurred_ts AT TIME ZONE 'UTC')::DATE)::VARCHAR AS event_date, event_type, count(*) AS rows FROM validated WHERE validation_error IS NULL GROUP BY 1, 2")
def src_05_partitioned_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Valid events written by day and read again with the day as a column."""
    place = _own_folder(spark, "by-day")
    sinks.write_by_day(validated(table(spark, folder, "bronze_event")).filter("validation_error IS NULL").select("event_id", "event_type", "event_date"), place)
    return readers.partitioned(spark, place).groupBy(F.col("event_date").cast("string").alias("event_date"), "event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT sale_id, branch_id, epoch_us(date_trunc('second', transaction_ts)) AS sale_micros, gross_sales_egp, net_sales_egp FROM sale_header")
def src_09_staged_text(spark: SparkSession, folder: str) -> DataFrame:
    """Sales written as CSV, read as text under a contract and typed again."""
    place = _own_folder(spark, "csv")
    sales = table(spark, folder, "sale_header").select("sale_id", "branch_id", F.date_trunc("second", "transaction_ts").alias("transaction_ts"), "gross_sales_egp", "net_sales_egp")
    contract = sales.schema
    sales.withColumn("transaction_ts", F.date_format("transaction_ts", "yyyy-MM-dd'T'HH:mm:ssXXX")).write.option("header", "true").option("escape", '"').csv(place)
    typed = readers.csv_under_contract(spark, place, contract)
    return typed.select("sale_id", "branch_id", F.unix_micros("transaction_ts").alias("sale_micros"), "gross_sales_egp", "net_sales_egp")


@query("SELECT day::VARCHAR AS day, n FROM (SELECT unnest(generate_series(DATE '2025-01-01', DATE '2025-12-31', INTERVAL 1 DAY))::DATE AS day, unnest(generate_series(1, 365)) AS n)")
def src_13_generated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered days without a table."""
    return spark.range(1, 366).select(F.date_add(F.lit("2024-12-31").cast("date"), F.col("id").cast("int")).cast("string").alias("day"), F.col("id").alias("n"))


@query("SELECT status, weight::INT AS weight FROM (VALUES ('PASS', 0), ('RUNNING', 1), ('FAIL', 2)) AS v(status, weight)")
def src_15_inline_values(spark: SparkSession, folder: str) -> DataFrame:
    """A small table written in the query."""
    return spark.range(1).select(F.expr("stack(3, 'PASS', 0, 'RUNNING', 1, 'FAIL', 2) AS (status, weight)"))


_LATEST = "(SELECT sale_id, branch_id, net_sales_egp, created_at FROM (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY created_at DESC, branch_id DESC NULLS LAST, net_sales_egp DESC NULLS LAST) AS k FROM sale_header WHERE sale_id IS NOT NULL AND created_at {0}) WHERE k = 1)"


def _latest(sales: DataFrame) -> DataFrame:
    order = F.struct("created_at", F.col("branch_id").isNotNull(), "branch_id", F.col("net_sales_egp").isNotNull(), "net_sales_egp")
    return sales.groupBy("sale_id").agg(F.max(order).alias("m")).select("sale_id", "m.branch_id", "m.net_sales_egp", "m.created_at")


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sales = table(spark, folder, "sale_header").filter("sale_id IS NOT NULL")
    border = F.lit("2025-05-01 00:00:00+00:00").cast("timestamp")
    return sales.filter(F.col("created_at") < border), sales.filter(F.col("created_at") >= border)


@query(f"WITH old AS {_LATEST.format('< ' + repr('2025-05-01 00:00:00+00'))}, new AS {_LATEST.format('>= ' + repr('2025-05-01 00:00:00+00'))} SELECT sale_id, branch_id, net_sales_egp FROM old WHERE sale_id NOT IN (SELECT sale_id FROM new) UNION ALL SELECT sale_id, branch_id, net_sales_egp FROM new")
def snk_07_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Sales of before May with those reloaded or made since in their place."""
    old, new = _halves(spark, folder)
    return sinks.upserted(_latest(old), _latest(new), ["sale_id"]).select("sale_id", "branch_id", "net_sales_egp")


@query(f"WITH old AS {_LATEST.format('< ' + repr('2025-05-01 00:00:00+00'))} SELECT sale_id FROM old UNION SELECT sale_id FROM sale_header WHERE sale_id IS NOT NULL AND created_at >= '2025-05-01 00:00:00+00'")
def snk_08_insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Sales of before May with those made since that weren't there."""
    old, new = _halves(spark, folder)
    return sinks.inserted(_latest(old), _latest(new), ["sale_id"]).select("sale_id")


@query("""SELECT h.sale_id, coalesce(max(l.units), max(h.units))::BIGINT AS units FROM (SELECT DISTINCT sale_id, 0 AS units FROM sale_header WHERE sale_id IS NOT NULL) AS h LEFT JOIN (SELECT sale_id, sum(quantity) AS units FROM sale_line GROUP BY 1) AS l ON h.sale_id = l.sale_id GROUP BY 1""")
def snk_10_update_from(spark: SparkSession, folder: str) -> DataFrame:
    """Sales whose units are set from their lines."""
    sales = table(spark, folder, "sale_header").select("sale_id").filter("sale_id IS NOT NULL").distinct().withColumn("units", F.lit(0).cast("long"))
    sums = table(spark, folder, "sale_line").groupBy("sale_id").agg(F.sum("quantity").alias("line_units"))
    return sinks.updated_from(sales, sums, ["sale_id"], {"units": "line_units"})


@query("SELECT run_id, epoch_us(started_at) AS started_micros FROM ingestion_run WHERE status <> 'PASS' AND started_at IS NOT NULL")
def snk_14_unpublished(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of an outbox without those already published (passed)."""
    runs = table(spark, folder, "ingestion_run").filter("started_at IS NOT NULL AND status IS NOT NULL")
    return sinks.unpublished(runs, runs.filter("status = 'PASS'"), "run_id", "started_at").select("run_id", F.unix_micros("started_at").alias("started_micros"))


@query(f"WITH {_VALIDATED} SELECT kafka_topic, kafka_partition, kafka_offset, validation_error FROM validated")
def stm_01_streamed_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """All envelopes through a stream that ends when it has read them, as it stored them."""
    place = _own_folder(spark, "stream")
    # as a pattern, since the table is a folder of files or one file, which alone can't be streamed
    stream = from_files(spark, f"{folder}/bronze_event.parque[t]", table(spark, folder, "bronze_event").schema)
    drain(stream, place, f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/records").select("kafka_topic", "kafka_partition", "kafka_offset", "validation_error")


_HASHED = "hashed AS (SELECT *, sha256(concat_ws('||', coalesce(event_id, ''), coalesce(event_type, ''), coalesce(schema_version, ''), coalesce(aggregate_type, ''), coalesce(aggregate_id, ''), coalesce(occurred_at, ''), coalesce(correlation_id, ''), coalesce(causation_id, ''), coalesce(payload, ''))) AS digest FROM bronze_event)"
_PLACES = "kafka_timestamp, kafka_topic, kafka_partition, kafka_offset"


@query(f"""WITH {_HASHED}, m AS (SELECT median(batch_id) AS b FROM bronze_event), ledger AS (SELECT event_id, arg_min(digest, struct_pack(a := kafka_timestamp, b := kafka_topic, c := kafka_partition, d := kafka_offset)) AS known FROM hashed, m WHERE batch_id < b AND event_id IS NOT NULL GROUP BY 1),
i AS (SELECT h.*, l.known, row_number() OVER (PARTITION BY h.event_id ORDER BY {_PLACES}) AS k, first_value(digest) OVER (PARTITION BY h.event_id ORDER BY {_PLACES}) AS first_digest FROM hashed AS h CROSS JOIN m LEFT JOIN ledger AS l ON h.event_id = l.event_id WHERE batch_id >= b)
SELECT kafka_topic, kafka_partition, kafka_offset, CASE WHEN known IS NOT NULL THEN CASE WHEN digest = known THEN 'duplicate' ELSE 'conflict' END WHEN event_id IS NULL OR k = 1 THEN 'new' WHEN digest = first_digest THEN 'duplicate' ELSE 'conflict' END AS status FROM i""")
def stm_11_against_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The newer half of the batches judged against a ledger of the older half."""
    records = table(spark, folder, "bronze_event").withColumn("digest", meaning_hash())
    middle = records.agg(F.percentile("batch_id", F.lit(0.5)).alias("b")).first()["b"]
    order = ["kafka_timestamp", "kafka_topic", "kafka_partition", "kafka_offset"]
    ledger = records.filter(F.col("batch_id") < middle).filter("event_id IS NOT NULL").groupBy("event_id").agg(F.min_by("digest", F.struct(*order)).alias("digest"))
    return against_ledger(records.filter(F.col("batch_id") >= middle), ledger, "event_id", "digest", order).select("kafka_topic", "kafka_partition", "kafka_offset", "status")


@query("""WITH changed AS (SELECT DISTINCT sale_id, product_id FROM sale_line WHERE created_at >= '2025-08-25 00:00:00+00'), seen AS (SELECT DISTINCT branch_id, sale_id FROM sale_header) SELECT DISTINCT branch_id, product_id FROM changed JOIN seen USING (sale_id) WHERE branch_id IS NOT NULL AND product_id IS NOT NULL
UNION SELECT branch_id, product_id FROM demand_attempt WHERE created_at >= '2025-08-25 00:00:00+00' AND branch_id IS NOT NULL AND product_id IS NOT NULL""")
def stm_13_affected_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Branch and product pairs that rows of the last week of August touch, from two tables."""
    since = F.col("created_at") >= F.lit("2025-08-25 00:00:00+00:00").cast("timestamp")
    lines = table(spark, folder, "sale_line").filter(since).select("sale_id", "product_id").distinct()
    sold = lines.join(table(spark, folder, "sale_header").select("sale_id", "branch_id").distinct(), "sale_id").select("branch_id", "product_id")
    asked = table(spark, folder, "demand_attempt").filter(since).select("branch_id", "product_id")
    return sold.unionByName(asked).dropna().distinct()


@query(f"""WITH ok AS (SELECT *, payload->>'$.purchase_order_id' AS root, CASE event_type WHEN 'purchase_order.created' THEN 1 WHEN 'goods_receipt.received' THEN 2 WHEN 'restock.applied' THEN 3 END AS stage FROM bronze_event WHERE json_valid(payload))
SELECT root, kafka_topic, kafka_partition, kafka_offset, row_number() OVER (PARTITION BY root ORDER BY stage, {_PLACES})::INT AS step FROM ok WHERE root IS NOT NULL AND stage IS NOT NULL""")
def stm_17_causal_order(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each order in causal order, whenever they arrived."""
    stage = F.when(F.col("event_type") == "purchase_order.created", 1).when(F.col("event_type") == "goods_receipt.received", 2).when(F.col("event_type") == "restock.applied", 3)
    events = table(spark, folder, "bronze_event").select(F.get_json_object("payload", "$.purchase_order_id").alias("root"), stage.alias("stage"), "kafka_timestamp", "kafka_topic", "kafka_partition", "kafka_offset").dropna(subset=["root", "stage"])
    step = F.row_number().over(Window.partitionBy("root").orderBy("stage", "kafka_timestamp", "kafka_topic", "kafka_partition", "kafka_offset"))
    return events.select("root", "kafka_topic", "kafka_partition", "kafka_offset", step.alias("step"))


@query("SELECT (transaction_ts AT TIME ZONE 'Africa/Cairo')::DATE::VARCHAR AS business_date, count(*) AS attempts, sum(requested_units)::BIGINT AS requested_units FROM demand_attempt WHERE transaction_ts IS NOT NULL GROUP BY 1")
def stm_18_refreshed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily demand stored without the rows that came late in the last month, then refreshed for 31 days."""
    place = _own_folder(spark, "daily")
    rows = table(spark, folder, "demand_attempt").filter("transaction_ts IS NOT NULL")
    fold = lambda part: branch_daily(part).groupBy("business_date").agg(F.sum("attempts").alias("attempts"), F.sum("requested_units").alias("requested_units"))
    last = rows.agg(F.max(business_day("transaction_ts")).alias("d")).first()["d"]
    late = (business_day("transaction_ts") > F.date_sub(F.lit(last), 31)) & (utc_day("created_at") > utc_day("transaction_ts"))
    fold(rows.filter(~F.coalesce(late, F.lit(False)))).write.partitionBy("business_date").parquet(place)
    refresh(rows, "transaction_ts", business_day, 31, fold, place)
    return readers.partitioned(spark, place).select(F.col("business_date").cast("string").alias("business_date"), "attempts", "requested_units")


@query(f"""WITH RECURSIVE e AS (SELECT branch_id, ts, rank, event_id, row_number() OVER (PARTITION BY branch_id ORDER BY ts, event_id) AS k FROM (SELECT payload->>'$.branch_id' AS branch_id, {_READ('occurred_at')} AS ts, least(TRY_CAST(payload->>'$.recommended_reorder_quantity' AS INT) // 40, 4) AS rank,
  concat_ws('/', kafka_topic, kafka_partition::VARCHAR, kafka_offset::VARCHAR) AS event_id FROM bronze_event WHERE event_type = 'inventory.reorder_required' AND json_valid(payload)) WHERE branch_id IS NOT NULL AND ts IS NOT NULL AND rank IS NOT NULL),
w AS (SELECT branch_id, k, ts AS last_at, rank AS last_rank, event_id, true AS fires FROM e WHERE k = 1 UNION ALL
  SELECT e.branch_id, e.k, CASE WHEN e.rank > w.last_rank OR epoch_us(e.ts) - epoch_us(w.last_at) >= 21600000000 THEN e.ts ELSE w.last_at END, CASE WHEN e.rank > w.last_rank OR epoch_us(e.ts) - epoch_us(w.last_at) >= 21600000000 THEN e.rank ELSE w.last_rank END, e.event_id, e.rank > w.last_rank OR epoch_us(e.ts) - epoch_us(w.last_at) >= 21600000000
  FROM w JOIN e ON e.branch_id = w.branch_id AND e.k = w.k + 1) SELECT branch_id, event_id FROM w WHERE fires""")
def stm_14_alerts_after_cooldown(spark: SparkSession, folder: str) -> DataFrame:
    """Reorder events of each branch that alert, at most one in six hours unless a graver one comes."""
    events = table(spark, folder, "bronze_event").filter("event_type = 'inventory.reorder_required'")
    grade = F.least(F.floor(F.get_json_object("payload", "$.recommended_reorder_quantity").try_cast("int") / 40), F.lit(4)).cast("int")
    place = F.concat_ws("/", "kafka_topic", F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string"))
    known = events.select(F.get_json_object("payload", "$.branch_id").alias("branch_id"), zoned_moment("occurred_at").alias("ts"), grade.alias("grade"), place.alias("event_id"))
    return alerts(known, "branch_id", "ts", "grade", "event_id", 6 * 3600).select("branch_id", "event_id")
