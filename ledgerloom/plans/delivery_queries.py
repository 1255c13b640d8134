"""Queries that take a table through a source or sink and back, or through cycles of batches, and give what came out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import event_builders as builders
from ..operators import quality
from ..operators.changes import reconciled
from ..operators.ranking import ranked
from ..registry import query
from ..session import cut, table
from ..sources import offsets as at
from ..sources import readers, sinks
from ..streaming.cycle import cut_over, run_cycle
from .storage_queries import _own_folder

_PLACE = ["kafka_topic", "kafka_partition", "kafka_offset"]


@query("SELECT governorate, locality_type, count(*) AS branches FROM pharmacy_branch GROUP BY 1, 2")
def src_04_files_below(spark: SparkSession, folder: str) -> DataFrame:
    """Branches written into folders within folders and read as one table, whatever the folders are named."""
    place = _own_folder(spark, "nested")
    branches = table(spark, folder, "pharmacy_branch")
    for kind in ("open", "closed"):
        branches.filter(F.coalesce("is_24_hours", F.lit(False)) if kind == "open" else ~F.coalesce("is_24_hours", F.lit(False))).write.parquet(f"{place}/hours/{kind}/files")
    return readers.files_below(spark, place).groupBy("governorate", "locality_type").agg(F.count(F.lit(1)).alias("branches"))


@query("SELECT run_id, stage, status, epoch_us(date_trunc('second', started_at)) AS started_micros, completed_at IS NOT NULL AS finished FROM ingestion_run")
def src_06_contracted_text(spark: SparkSession, folder: str) -> DataFrame:
    """Runs written as text with their columns in another order and one more, read under a contract."""
    place = _own_folder(spark, "runs")
    runs = table(spark, folder, "ingestion_run")
    moment = lambda c: F.date_format(F.date_trunc("second", c), "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c)
    runs.select("status", moment("completed_at"), "run_id", F.lit("x").alias("extra"), moment("started_at"), "stage").write.option("header", "true").option("escape", '"').csv(place)
    contract = T.StructType([T.StructField(c, T.TimestampType() if c.endswith("_at") else T.StringType()) for c in ("run_id", "stage", "status", "started_at", "completed_at")])
    read = readers.csv_under_contract(spark, place, contract)
    return read.select("run_id", "stage", "status", F.unix_micros("started_at").alias("started_micros"), F.col("completed_at").isNotNull().alias("finished"))


@query("SELECT sale_line_id, sale_id, quantity, net_sales_egp FROM sale_line")
def snk_03_bounded_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as compressed files of bounded rows, sorted within, read again."""
    place = _own_folder(spark, "lines")
    sinks.write_plain(table(spark, folder, "sale_line").select("sale_line_id", "sale_id", "quantity", "net_sales_egp"), place, ["sale_id", "sale_line_id"])
    return spark.read.parquet(place)


@query("SELECT price_observation_id, product_id, price_egp FROM product_price_history WHERE price_observation_id IS NOT NULL AND product_id IS NOT NULL")
def snk_05_replaced_table(spark: SparkSession, folder: str) -> DataFrame:
    """Prices put in place of an older table only after they were staged and checked; the table as it is then."""
    place = _own_folder(spark, "prices")
    prices = table(spark, folder, "product_price_history").select("price_observation_id", "product_id", "price_egp")
    old = prices.filter("product_id IS NOT NULL AND price_egp > 100")
    sinks.replace_checked(spark, old, place, ["price_observation_id", "product_id"], ["price_observation_id"])
    whole = prices.filter("price_observation_id IS NOT NULL AND product_id IS NOT NULL")
    sinks.replace_checked(spark, whole, place, ["price_observation_id", "product_id"], ["price_observation_id"])
    return spark.read.parquet(place)


@query("SELECT kafka_topic, count(*) AS rows, count(DISTINCT batch_id) AS batches FROM bronze_event GROUP BY 1")
def snk_06_batches_appended_once(spark: SparkSession, folder: str) -> DataFrame:
    """Events of early and late batches added under the names of their ranges, one of them twice as after a broken run."""
    place = _own_folder(spark, "appended")
    events = table(spark, folder, "bronze_event").select(*_PLACE, "batch_id", F.concat_ws("/", "kafka_topic", F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string")).alias("place"))
    middle = events.agg(F.percentile("batch_id", F.lit(0.5)).cast("long").alias("m")).first()["m"] or 0
    early = F.coalesce(F.col("batch_id") <= middle, F.lit(True))
    for name, rows in (("early", events.filter(early)), ("late", events.filter(~early)), ("late", events.filter(~early))):
        sinks.append_once(spark, rows, place, name, "place")
    return spark.read.parquet(place).groupBy("kafka_topic").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("batch_id").alias("batches"))


@query("SELECT kafka_topic, kafka_partition, min(kafka_offset) AS first_offset, max(kafka_offset) + 1 AS end_offset FROM bronze_event WHERE kafka_topic IS NOT NULL GROUP BY 1, 2")
def src_16_manifest_of_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """The ranges of all partitions written as two manifests and read from them."""
    place = _own_folder(spark, "manifest")
    bounds = table(spark, folder, "bronze_event").filter("kafka_topic IS NOT NULL").groupBy("kafka_topic", "kafka_partition").agg(F.min("kafka_offset").alias("first"), (F.max("kafka_offset") + 1).alias("end"))
    for name in ("first", "end"):
        ends: at.Offsets = {}
        for r in bounds.collect():  # one row a partition of a topic
            ends.setdefault(r["kafka_topic"], {})[str(r["kafka_partition"])] = r[name]
        at.write_json(f"{place}/{name}.json", ends)
    first, end = (at.read_manifest(f"{place}/{name}.json") for name in ("first", "end"))
    rows = [(t, int(p), first[t][p], end[t][p]) for t in first for p in first[t]]
    return spark.createDataFrame(rows, "kafka_topic string, kafka_partition int, first_offset long, end_offset long")


@query("SELECT kafka_topic AS source_topic, count(*) AS rows FROM bronze_event GROUP BY 1")
def stm_03_cycles_to_the_end(spark: SparkSession, folder: str) -> DataFrame:
    """All events, numbered without gaps, taken by cycles of a third each until nothing is left, with one manifest."""
    place = _own_folder(spark, "cycles")
    events = table(spark, folder, "bronze_event").select(F.col("kafka_topic").alias("source_topic"), "kafka_partition", F.col("kafka_offset").alias("source_offset"))
    numbered = ranked(events, "source_topic", "kafka_partition", "source_offset")
    topic = cut(numbered.select("source_topic", F.lit("all").alias("kafka_topic"), F.lit(0).alias("kafka_partition"), (F.col("rank") - 1).alias("kafka_offset")))
    low, high = {"all": {"0": 0}}, {"all": {"0": topic.count()}}
    manifest = f"{place}/offsets.json"
    at.write_json(manifest, low)
    while run_cycle(spark, topic, manifest, low, high, f"{place}/events", "kafka_offset", max(1, -(-high["all"]["0"] // 3)))["batch"]:
        pass
    return spark.read.parquet(f"{place}/events").groupBy("source_topic").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT sale_id, count(*) AS copies FROM sale_header WHERE sale_id IS NOT NULL GROUP BY 1")
def stm_07_cut_over(spark: SparkSession, folder: str) -> DataFrame:
    """Sales of before May as a snapshot, with the changes made while it was taken caught up with; each with its copies."""
    sales = table(spark, folder, "sale_header").filter("sale_id IS NOT NULL").groupBy("sale_id").agg(F.count(F.lit(1)).alias("copies"), F.min("created_at").alias("made"))
    border = F.lit("2025-05-01 00:00:00+00:00").cast("timestamp")
    reads = iter(({"sales": {"0": 0}}, {"sales": {"0": 1}}))  # what the log holds before and after the snapshot

    def changes(before: at.Offsets, after: at.Offsets) -> DataFrame:
        return sales.filter(~F.coalesce(F.col("made") < border, F.lit(True))).withColumns({"op": F.lit("c"), "lsn": F.lit(1)}).drop("made")

    snapshot = lambda: sales.filter(F.coalesce(F.col("made") < border, F.lit(True))).drop("made")
    whole, _ = cut_over(lambda: next(reads), snapshot, changes, lambda base, late: reconciled(base, late, ["sale_id"], ["lsn"]))
    return whole


@query("SELECT p AS kafka_partition, CASE p WHEN 0 THEN 40 WHEN 1 THEN 30 ELSE 30 END AS records FROM (SELECT unnest([0, 1, 2]) AS p)")
def stm_04_fair_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What each of three partitions gives to a batch of 100 when one is far behind and two have less: no busy one starves another."""
    start, high = {"t": {"0": 0, "1": 0, "2": 0}}, {"t": {"0": 5000, "1": 30, "2": 30}}
    end = at.fair_end(start, high, 100)
    return spark.createDataFrame([(int(p), end["t"][p] - start["t"][p]) for p in end["t"]], "kafka_partition int, records int")


@query("SELECT 't' AS kafka_topic, 1 AS kafka_partition")
def stm_05_lost_records(spark: SparkSession, folder: str) -> DataFrame:
    """Partitions whose records are gone before they were taken."""
    found = at.gaps({"t": {"0": 10, "1": 10}}, {"t": {"0": 10, "1": 11}})
    return spark.createDataFrame([(t, int(p)) for t, p in found], "kafka_topic string, kafka_partition int")


@query("""WITH k AS (SELECT min(branch_id) AS b FROM demand_attempt WHERE branch_id IS NOT NULL), p AS (SELECT b, (SELECT min(product_id) FROM demand_attempt, k WHERE branch_id = b) AS p FROM k)
SELECT branch_id, product_id, count(*) AS attempts, sum(requested_units)::BIGINT AS requested, sum(lost_units)::BIGINT AS lost, epoch_us(max(transaction_ts)) AS last_micros FROM demand_attempt JOIN p ON branch_id = b AND product_id = p GROUP BY 1, 2""")
def src_12_point_read(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of one pair, as a service asks for them: the first product of the first branch. Its key reaches the scan."""
    attempts = table(spark, folder, "demand_attempt")
    branch = attempts.agg(F.min("branch_id").alias("b")).first()["b"]
    product = attempts.filter(F.col("branch_id") == branch).agg(F.min("product_id").alias("p")).first()["p"]
    return point_read(attempts, {"branch_id": branch, "product_id": product}).groupBy("branch_id", "product_id").agg(F.count(F.lit(1)).alias("attempts"), F.sum("requested_units").alias("requested"), F.sum("lost_units").alias("lost"), F.unix_micros(F.max("transaction_ts")).alias("last_micros"))


def point_read(rows: DataFrame, key: dict) -> DataFrame:
    """The rows of one key; as equalities with values, which skip files and row groups. A null in the key matches nothing."""
    for column, value in key.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows


_INVARIANTS = {
    "demand_attempt": {"units_add_up": "requested_units = fulfilled_units + lost_units", "units_not_negative": "requested_units >= 0 AND fulfilled_units >= 0 AND lost_units >= 0", "outcome_fits_units": "CASE outcome WHEN 'OUT_OF_STOCK' THEN fulfilled_units = 0 WHEN 'FULFILLED' THEN fulfilled_units > 0 ELSE fulfilled_units < requested_units END"},
    "sale_header": {"net_is_gross_less_discount": "abs(gross_sales_egp - discount_amount_egp - net_sales_egp) <= 0.01", "made_after_the_sale": "created_at >= transaction_ts"},
    "sale_line": {"quantity_positive": "quantity > 0", "selling_price_within_retail": "selling_unit_price_egp <= retail_unit_price_egp"},
    "product_price_history": {"learned_after_seen": "loaded_at >= observed_at", "price_positive": "price_egp > 0"},
    "pharmacy_branch": {"open_to_customers": "checkout_points >= 1", "known_place": "length(trim(governorate)) > 0"},
    "ingestion_run": {"ends_after_its_start": "completed_at >= started_at"},
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{n}' AS rule, count(*) FILTER (({r}) IS NOT TRUE) AS broken_rows FROM {t}" for t, rules in _INVARIANTS.items() for n, r in rules.items()))
def alg_33_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table that break what must hold in its domain, nulls included; one pass a table."""
    united = None
    for name, rules in _INVARIANTS.items():
        own = quality.broken_rules(table(spark, folder, name), {n: F.expr(r) for n, r in rules.items()}).select(F.lit(name).alias("table_name"), "rule", "broken_rows")
        united = own if united is None else united.unionByName(own)
    return united


_KINDS = {
    "sale.units_fulfilled": ("demand_id", "fulfilled_quantity"), "inventory.quantity_changed": ("movement_id", None), "inventory.reorder_required": ("event_id", None),
    "purchase_order.created": ("purchase_order_id", None), "goods_receipt.received": ("receipt_id", None), "restock.applied": ("movement_id", None),
}
_OWN_KEY = lambda key: "event_id" if key == "event_id" else f"payload->>'$.{key}'"
_IDENTITY = lambda key: "event_id || (payload->>'$.product_id')" if key == "event_id" else _OWN_KEY(key)


@query("WITH ok AS (SELECT * FROM bronze_event WHERE json_valid(payload)) " + " UNION ALL ".join(f"SELECT '{kind}' AS event_type, count(*) AS events, count(DISTINCT {_IDENTITY(key)}) AS identities, {'count(*)' if kind in ('inventory.quantity_changed', 'inventory.reorder_required', 'goods_receipt.received', 'restock.applied') else '0'} AS caused FROM ok WHERE event_type = '{kind}' AND {_OWN_KEY(key)} IS NOT NULL{f' AND TRY_CAST(payload->>{chr(39)}$.{units}{chr(39)} AS BIGINT) > 0' if units else ''}" for kind, (key, units) in _KINDS.items()))
def alg_34_events_of_all_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all six kinds built anew from what their payloads say, with their identities and how many name a cause."""
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    numbers = ["requested_quantity", "fulfilled_quantity", "lost_quantity", "quantity_delta", "on_hand_before", "on_hand_after", "inventory_version_after", "inventory_version", "available_quantity", "reorder_point", "target_stock_level", "recommended_reorder_quantity", "line_count", "ordered_units", "received_units"]
    texts = ["movement_id", "basket_id", "branch_id", "product_id", "channel", "fulfillment_status", "purchase_order_id", "procurement_cycle_id", "supplier_id", "expected_delivery_on", "receipt_id"]
    read = table(spark, folder, "bronze_event").filter(F.get_json_object("payload", "$").isNotNull())
    rows = read.select("event_type", "event_id", F.col("occurred_at"), F.col("occurred_at").alias("ordered_at"), F.col("occurred_at").alias("received_at"), F.coalesce(field("demand_id"), field("reference_id"), F.col("event_id")).alias("demand_id"), *[field(t).alias(t) for t in texts], *[field(n).try_cast("long").alias(n) for n in numbers])
    of = lambda kind, key: rows.filter((F.col("event_type") == kind) & F.col(key).isNotNull())
    built = [
        builders.sale_events(of("sale.units_fulfilled", "demand_id")), builders.sale_inventory_events(of("inventory.quantity_changed", "movement_id")), builders.reorder_events(of("inventory.reorder_required", "event_id").withColumn("movement_id", F.col("event_id"))),
        builders.purchase_order_events(of("purchase_order.created", "purchase_order_id")), builders.receipt_events(of("goods_receipt.received", "receipt_id")), builders.restock_events(of("restock.applied", "movement_id")),
    ]
    counted = [events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("identities"), F.count("causation_id").alias("caused")) for events in built]
    united = counted[0]
    for part in counted[1:]:
        united = united.unionByName(part)
    return united
