"""Single entries of the inventory that have no home elsewhere: hashes, texts, arrays, ladders, ordered parts, runs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprints import blake2b_number, farm_fingerprint
from ..functions.identity import uuid_bytes
from ..functions.numbers import EXPIRY, ladder
from ..functions.temporal import zoned_moment
from ..functions.text import casefolded, first_marker
from ..operators.changes import decoded, topic_of_source
from ..operators.running import along
from ..registry import query
from ..session import table
from ..sources import readers, sinks
from .event_queries import _READ
from .storage_queries import _own_folder


@query()
def hash_08_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """The warehouse's fingerprint of each pair of branch and product, by which samples are drawn there."""
    pairs = table(spark, folder, "demand_attempt").select("branch_id", "product_id").dropna().distinct()
    return pairs.withColumn("fingerprint", farm_fingerprint(F.concat_ws("|", "branch_id", "product_id")))


@query()
def hash_09_product_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A number of each product from the BLAKE2b hash of its UUID's bytes, and its place among 100."""
    products = table(spark, folder, "master_product").select("product_id").filter("product_id IS NOT NULL").distinct()
    score = blake2b_number(F.coalesce(uuid_bytes("product_id"), F.encode("product_id", "UTF-8")))
    return products.withColumn("score", score).withColumn("bucket", F.pmod("score", F.lit(100).cast("decimal(20,0)")).cast("int"))


@query("SELECT stage, source_label, status, substr(sha256(concat_ws('|', coalesce(stage, ''), coalesce(source_label, ''), coalesce(status, ''))), 1, 20) AS identity, count(*) AS runs FROM ingestion_run GROUP BY 1, 2, 3")
def hash_05_group_identities(spark: SparkSession, folder: str) -> DataFrame:
    """An identity of 20 digits for each stage, source and status of runs."""
    parts = [F.coalesce(c, F.lit("")) for c in ("stage", "source_label", "status")]
    runs = table(spark, folder, "ingestion_run").groupBy("stage", "source_label", "status").agg(F.count(F.lit(1)).alias("runs"))
    return runs.select("stage", "source_label", "status", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20).alias("identity"), "runs")


@query("SELECT replace(lower(manufacturer), 'ß', 'ss') AS folded, count(*) AS records, count(DISTINCT manufacturer) AS spellings FROM master_product WHERE manufacturer IS NOT NULL GROUP BY 1")
def str_05_casefolded_makers(spark: SparkSession, folder: str) -> DataFrame:
    """Makers by their case-folded spelling."""
    known = table(spark, folder, "master_product").filter("manufacturer IS NOT NULL")
    return known.groupBy(casefolded(F.col("manufacturer")).alias("folded")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("manufacturer").alias("spellings"))


#: Markers of names that a catalogue leaves out, in the order in which they are named.
MARKERS = ["& sons", "pharma", "s.a.e", "remedies", "labor"]


@query("SELECT product_id, CASE " + " ".join(f"WHEN contains(upper(manufacturer), '{m.upper()}') THEN '{m}'" for m in MARKERS) + " END AS marker FROM master_product")
def str_07_first_markers(spark: SparkSession, folder: str) -> DataFrame:
    """The first marker that each product's maker holds."""
    return table(spark, folder, "master_product").select("product_id", first_marker(F.col("manufacturer"), MARKERS).alias("marker"))


@query("""SELECT run_id, array_to_string(list_filter(regexp_extract_all(input_row_counts, '"([a-z_]+)"', 1), lambda x: length(x) > 6), ',') AS inputs_kept, len(list_filter(regexp_extract_all(input_row_counts, '"([a-z_]+)"', 1), lambda x: length(x) > 6)) > 0 AS usable FROM ingestion_run WHERE input_row_counts IS NOT NULL""")
def arr_02_filtered_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """The names of inputs longer than six letters of each run, and whether there are any."""
    named = F.regexp_extract_all("input_row_counts", F.lit('"([a-z_]+)"'), 1)
    kept = F.filter(named, lambda name: F.length(name) > 6)
    return table(spark, folder, "ingestion_run").filter("input_row_counts IS NOT NULL").select("run_id", F.array_join(kept, ",").alias("inputs_kept"), (F.size(kept) > 0).alias("usable"))


#: The steps of ladders and what lies beyond them: days as shown, prices, risk as a multiple of its threshold.
EXPIRY_SHOWN = ([(-1, "Expired"), (30, "0-30 days"), (90, "31-90 days"), (180, "91-180 days")], "180+ days")
PRICES = ([(50, "0-50 EGP"), (200, "50-200 EGP"), (1000, "200-1000 EGP")], "1000+ EGP")
SEVERITY = ([(2, "WATCH"), (4, "MEDIUM"), (8, "HIGH")], "CRITICAL")


def _case(value: str, steps: tuple, strict: bool = False) -> str:
    whens = " ".join(f"WHEN {value} {'<' if strict else '<='} {bound} THEN '{name}'" for bound, name in steps[0])
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE '{steps[1]}' END"


@query(f"""WITH o AS (SELECT *, (max(loaded_at) OVER () AT TIME ZONE 'UTC')::DATE - (loaded_at AT TIME ZONE 'UTC')::DATE AS days FROM product_price_history)
SELECT {_case('days', EXPIRY)} AS age_step, {_case('days', EXPIRY_SHOWN)} AS shown_step, {_case('price_egp', PRICES)} AS price_band, {_case('price_egp / 40', SEVERITY, True)} AS severity, count(*) AS observations FROM o GROUP BY 1, 2, 3, 4""")
def case_01_ladders(spark: SparkSession, folder: str) -> DataFrame:
    """Price observations by four ladders: two of days, one of prices, one of multiples of a threshold (40)."""
    rows = table(spark, folder, "product_price_history")
    last = rows.agg(F.max("loaded_at").alias("last"))  # one row
    days = F.datediff(F.to_date("last"), F.to_date("loaded_at"))
    placed = rows.join(F.broadcast(last)).select(days.alias("days"), "price_egp")
    steps = [ladder(F.col("days"), *EXPIRY).alias("age_step"), ladder(F.col("days"), *EXPIRY_SHOWN).alias("shown_step"), ladder(F.col("price_egp"), *PRICES).alias("price_band"), ladder(F.col("price_egp") / 40, *SEVERITY, strict=True).alias("severity")]
    return placed.groupBy(*steps).agg(F.count(F.lit(1)).alias("observations"))


@query("WITH a AS (SELECT max(transaction_ts) AS as_of FROM demand_attempt) SELECT demand_attempt_id, greatest(round((epoch_us(as_of) - epoch_us(created_at)) / 3600000000.0, 6), 0.0)::DOUBLE AS age_hours FROM demand_attempt, a WHERE created_at IS NOT NULL AND demand_attempt_id IS NOT NULL")
def dt_11_age_in_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Hours from each attempt's making to the last transaction, none for later ones; no clock is read."""
    rows = table(spark, folder, "demand_attempt")
    as_of = rows.agg(F.max("transaction_ts").alias("as_of"))  # one row
    hours = F.round((F.unix_micros("as_of") - F.unix_micros("created_at")) / F.lit(3_600_000_000.0), 6)
    return rows.filter("created_at IS NOT NULL AND demand_attempt_id IS NOT NULL").join(F.broadcast(as_of)).select("demand_attempt_id", F.greatest(hours, F.lit(0.0)).alias("age_hours"))


@query("SELECT demand_attempt_id, requested_units, fulfilled_units, requested_units - fulfilled_units AS open_units FROM demand_attempt WHERE demand_attempt_id IS NOT NULL")
def prj_04_generated_column(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts with a column that two others generate."""
    return table(spark, folder, "demand_attempt").filter("demand_attempt_id IS NOT NULL").select("demand_attempt_id", "requested_units", "fulfilled_units", (F.col("requested_units") - F.col("fulfilled_units")).alias("open_units"))


@query("SELECT kafka_topic, kafka_partition, kafka_offset FROM bronze_event WHERE aggregate_type IS DISTINCT FROM 'acceptance_smoke' AND NOT coalesce(CASE WHEN json_valid(payload) THEN lower(payload->>'$.acceptance_smoke') = 'true' END, false)")
def flt_09_without_smoke_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events without those of acceptance runs, by their type and by a flag in the payload; a missing flag is none."""
    smoke = F.coalesce(F.lower(F.get_json_object("payload", "$.acceptance_smoke")) == "true", F.lit(False))
    return table(spark, folder, "bronze_event").filter(~F.col("aggregate_type").eqNullSafe("acceptance_smoke") & ~smoke).select("kafka_topic", "kafka_partition", "kafka_offset")


_PLACES = "kafka_topic, kafka_partition, kafka_offset"


@query(f"""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changes FROM bronze_event WINDOW w AS (PARTITION BY kafka_topic, kafka_partition ORDER BY kafka_offset)),
r AS (SELECT *, sum(changes) OVER (PARTITION BY kafka_topic, kafka_partition ORDER BY kafka_offset ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT kafka_topic, kafka_partition, run::BIGINT AS run, min(event_type) AS event_type, min(kafka_offset) AS first_offset, max(kafka_offset) AS last_offset, count(*) AS rows FROM r GROUP BY 1, 2, 3""")
def src_08_adjacent_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of neighbouring records of one type in each topic's partition, as a scan in order would find them, without one."""
    own = ["kafka_topic", "kafka_partition"]
    read = table(spark, folder, "bronze_event").select(*own, "kafka_offset", "event_type", F.struct("event_type").alias("this"))
    before = along(read, own, ["kafka_offset"], previous={"before": F.col("this")})
    changes = F.when(F.col("before").isNotNull() & F.col("before.event_type").eqNullSafe(F.col("event_type")), 0).otherwise(1)
    runs = along(before.withColumn("changes", changes).drop("this", "before"), own, ["kafka_offset"], {"run": F.col("changes").cast("long")})
    return runs.groupBy(*own, "run").agg(F.min("event_type").alias("event_type"), F.min("kafka_offset").alias("first_offset"), F.max("kafka_offset").alias("last_offset"), F.count(F.lit(1)).alias("rows"))


@query("SELECT branch_id, count(*) AS sales, sum(net_sales_egp) AS net_sales FROM sale_header WHERE branch_id IS NOT NULL GROUP BY 1")
def snk_15_partitioned_text(spark: SparkSession, folder: str) -> DataFrame:
    """Sales written as CSV in parts of a few branches with a manifest, read again in the parts' order and folded."""
    place = _own_folder(spark, "parts")
    sales = table(spark, folder, "sale_header").filter("branch_id IS NOT NULL").select("branch_id", "sale_id", "net_sales_egp")
    manifest = sinks.write_text_parts(sales, place, "branch_id", 25)
    read = readers.ordered_parts(spark, place, sales.schema, manifest)
    return read.groupBy("branch_id").agg(F.count(F.lit(1)).alias("sales"), F.sum("net_sales_egp").alias("net_sales"))


@query(f"""WITH since AS (SELECT TIMESTAMPTZ '2025-08-25 00:00:00+00' AS t), lines AS (SELECT DISTINCT sale_id, product_id FROM sale_line, since WHERE created_at >= t), heads AS (SELECT DISTINCT sale_id FROM sale_header, since WHERE created_at >= t), seen AS (SELECT DISTINCT branch_id, sale_id FROM sale_header)
SELECT branch_id, product_id, 'sale_line' AS source FROM lines JOIN seen USING (sale_id) WHERE branch_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2
UNION SELECT branch_id, product_id, 'sale_header' FROM heads JOIN seen USING (sale_id) JOIN (SELECT DISTINCT sale_id, product_id FROM sale_line) USING (sale_id) WHERE branch_id IS NOT NULL AND product_id IS NOT NULL
UNION SELECT branch_id, product_id, 'demand_attempt' FROM demand_attempt, since WHERE created_at >= t AND branch_id IS NOT NULL AND product_id IS NOT NULL
UNION SELECT payload->>'$.branch_id' AS b, payload->>'$.product_id' AS p, 'inventory' FROM (SELECT * FROM bronze_event WHERE json_valid(payload)), since WHERE event_type = 'inventory.quantity_changed' AND {_READ('occurred_at')} >= t AND b IS NOT NULL AND p IS NOT NULL
UNION SELECT d.branch_id, d.product_id, 'price' FROM (SELECT DISTINCT product_id FROM product_price_history, since WHERE loaded_at >= t) AS c JOIN (SELECT DISTINCT branch_id, product_id FROM demand_attempt WHERE branch_id IS NOT NULL) AS d USING (product_id)""")
def stm_13_affected_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that changes of the last week of August touch, by the table that changed: five sources, without a cap."""
    since = F.lit("2025-08-25 00:00:00+00:00").cast("timestamp")
    recent = lambda name, moment="created_at": table(spark, folder, name).filter(F.col(moment) >= since)
    seen = table(spark, folder, "sale_header").select("sale_id", "branch_id").distinct()
    products = table(spark, folder, "sale_line").select("sale_id", "product_id").distinct()
    asked = table(spark, folder, "demand_attempt").select("branch_id", "product_id")
    moved = table(spark, folder, "bronze_event").filter("event_type = 'inventory.quantity_changed'").filter(F.get_json_object("payload", "$").isNotNull() & (zoned_moment("occurred_at") >= since))
    sources = {
        "sale_line": recent("sale_line").select("sale_id", "product_id").distinct().join(seen, "sale_id"),
        "sale_header": recent("sale_header").select("sale_id").distinct().join(seen, "sale_id").join(products, "sale_id"),
        "demand_attempt": recent("demand_attempt"),
        "inventory": moved.select(F.get_json_object("payload", "$.branch_id").alias("branch_id"), F.get_json_object("payload", "$.product_id").alias("product_id")),
        "price": recent("product_price_history", "loaded_at").select("product_id").distinct().join(asked.distinct(), "product_id"),
    }
    united = None
    for name, pairs in sources.items():
        own = pairs.select("branch_id", "product_id").dropna().distinct().withColumn("source", F.lit(name))
        united = own if united is None else united.unionByName(own)
    return united


@query("""SELECT kafka_topic, event_type, count(*) AS rows, count(*) FILTER (kafka_topic IS NOT DISTINCT FROM ('warehouse.' || split_part(event_type, '.', 1) || '.' || split_part(event_type, '.', 2))) AS rows_of_their_source FROM bronze_event GROUP BY 1, 2""")
def alg_43_topics_against_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Change records made of events, decoded, with how many came by the topic that their source names."""
    parts = F.split("event_type", r"\.")
    record = F.to_json(F.struct(F.struct(F.get(parts, F.lit(0)).alias("schema"), F.get(parts, F.lit(1)).alias("table")).alias("source"), F.lit("c").alias("op")))
    read = decoded(table(spark, folder, "bronze_event").select("kafka_topic", "event_type", record.alias("value")))
    return read.groupBy("kafka_topic", "event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(topic_of_source("warehouse", "kafka_topic"), F.lit(False))).alias("rows_of_their_source"))
