import http.server
import json
import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.identity import name_uuid
from ledgerloom.sources import offsets, paged, readers, sinks
from ledgerloom.streaming.bronze import accounts, drain, from_files
from ledgerloom.streaming.cooldown import alerts
from ledgerloom.streaming.ledger import against_ledger
from ledgerloom.streaming.refresh import refresh
from test_events_and_changes import GOOD, envelopes


def test_fair_end_fills_evenly():
    start = {"a": {"0": 0, "1": 10}, "b": {"0": 5}}
    high = {"a": {"0": 1000, "1": 12}, "b": {"0": 105}}
    assert offsets.fair_end(start, high, 5000) == high
    assert offsets.fair_end(start, high, 52) == {"a": {"0": 25, "1": 12}, "b": {"0": 30}}
    assert offsets.fair_end(start, high, 53) == {"a": {"0": 26, "1": 12}, "b": {"0": 30}}
    assert offsets.fair_end(start, high, 1) == {"a": {"0": 1, "1": 10}, "b": {"0": 5}}
    assert offsets.fair_end(start, start, 9) == start
    for most in range(1, 1200, 37):
        end = offsets.fair_end(start, high, most)
        assert offsets.records_between(start, end) == min(most, 1102)


def test_offset_rules():
    with pytest.raises(ValueError, match="backwards"):
        offsets.records_between({"a": {"0": 5}}, {"a": {"0": 4}})
    with pytest.raises(ValueError, match="differ"):
        offsets.records_between({"a": {"0": 5}}, {"a": {"0": 6, "1": 1}})
    for bad in ({}, {"a": {}}, {"a": {"x": 1}}, {"a": {"0": -1}}, {"a": {"0": True}}, None):
        with pytest.raises(ValueError):
            offsets.check_shape(bad)
    assert offsets.with_new_partitions({"a": {"0": 5}}, {"a": {"0": 1, "1": 3}, "b": {"0": 7}}) == {"a": {"0": 5, "1": 3}, "b": {"0": 7}}
    assert offsets.gaps({"a": {"0": 5, "1": 9}}, {"a": {"0": 6, "1": 9}}) == [("a", "0")]
    one = offsets.batch_name({"a": {"0": 1}}, {"a": {"0": 2}})
    assert len(one) == 20 and one == offsets.batch_name({"a": {"0": 1}}, {"a": {"0": 2}}) != offsets.batch_name({"a": {"0": 1}}, {"a": {"0": 3}})


def test_manifest_is_whole(spark, tmp_path):
    offsets.write_json(tmp_path / "x/offsets.json", {"a": {"0": 3}})
    assert offsets.read_manifest(tmp_path / "x/offsets.json") == {"a": {"0": 3}} and not list(tmp_path.rglob("*.tmp"))


def test_bounded_records(spark, rows):
    frame = spark.createDataFrame([("a", 0, i) for i in range(10)] + [("b", 0, 3)], "kafka_topic string, kafka_partition int, kafka_offset long")
    assert rows(offsets.bounded(frame, {"a": {"0": 3}}, {"a": {"0": 5}})) == [("a", 0, 3), ("a", 0, 4)]


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffprice,name,extra\n1.50,"x, ""y""",1\nabc,,2\n', encoding="utf-8")
    contract = T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.DecimalType(8, 2)), T.StructField("note", T.StringType())])
    found = readers.csv_under_contract(spark, str(tmp_path / "a.csv"), contract, required=["name", "price"]).collect()
    assert [(r["name"], str(r["price"]), r["note"]) for r in found] == [('x, "y"', "1.50", None), (None, "None", None)]
    with pytest.raises(ValueError, match="note"):
        readers.csv_under_contract(spark, str(tmp_path / "a.csv"), contract)


def test_contract_differences(spark):
    frame = spark.createDataFrame([], "a string, b int, c decimal(4,2), d date")
    assert readers.contract_differences(frame, {"a": "STRING", "b": "INT64", "c": "NUMERIC", "d": "DATE"}) == []
    assert readers.contract_differences(frame, {"a": "INT64", "b": "INT64", "c": "NUMERIC", "x": "DATE"}) == ["missing: x", "unknown: d", "a: string is no INT64"]


def test_paged_source(spark):
    class Service(http.server.BaseHTTPRequestHandler):
        failed = set()

        def do_GET(self):  # noqa: N802
            skip, limit = (int(x) for x in self.path.strip("/").split("-"))
            if skip == 20 and skip not in self.failed:
                self.failed.add(skip)
                self.send_response(503)
                self.end_headers()
                return
            body = json.dumps({"results": [{"id": i} for i in range(skip, min(skip + limit, 45))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        paged.register(spark)
        read = lambda **o: sorted(json.loads(r["record"])["id"] for r in spark.read.format("paged_json").options(url=f"http://127.0.0.1:{server.server_port}/{{skip}}-{{limit}}", limit=10, **o).load().collect())
        assert read(total=45) == list(range(45)) and read(total=45, most=45) == list(range(45))
        with pytest.raises(Exception, match="45 rows, but the service gives 15 at most"):
            read(total=45, most=15)
        with pytest.raises(Exception, match="results of"):
            read(total=65)
    finally:
        server.shutdown()


def test_replace_checked_keeps_the_old_table(spark, rows, tmp_path):
    place = str(tmp_path / "t")
    frame = lambda records: spark.createDataFrame(records, "k int, v string")
    assert sinks.replace_checked(spark, frame([(1, "a")]), place, ["v"], ["k"]) == 1
    for bad in ([(1, None)], [(1, "x"), (1, "y")]):
        with pytest.raises(ValueError):
            sinks.replace_checked(spark, frame(bad), place, ["v"], ["k"])
    assert rows(spark.read.parquet(place)) == [(1, "a")]
    assert sinks.replace_checked(spark, frame([(1, "b"), (2, "c")]), place, ["v"], ["k"]) == 2
    assert rows(spark.read.parquet(place)) == [(1, "b"), (2, "c")] and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_append_once_and_upserts(spark, rows, tmp_path):
    frame = spark.createDataFrame([("e1", 1), ("e2", 2)], "id string, n int")
    for _ in range(2):
        assert sinks.append_once(spark, frame, str(tmp_path / "d"), "b1", "id") == 2
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    with pytest.raises(ValueError):
        sinks.append_once(spark, frame.union(frame), str(tmp_path / "d"), "b2", "id")
    update = spark.createDataFrame([("e2", 9), ("e3", 3)], "id string, n int")
    assert rows(sinks.upserted(frame, update, ["id"])) == [("e1", 1), ("e2", 9), ("e3", 3)]
    assert rows(sinks.inserted(frame, update.union(update), ["id"])) == [("e1", 1), ("e2", 2), ("e3", 3)]
    assert rows(sinks.updated_from(frame, update, ["id"], {"n": "n"})) == [("e1", 1), ("e2", 9)]


def test_capped_files_and_days(spark, rows, tmp_path):
    frame = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("event_date"))
    sinks.write_by_day(frame, str(tmp_path / "days"))
    assert readers.partitioned(spark, str(tmp_path / "days"), "event_date=1").count() == 33
    sinks.write_plain(frame, str(tmp_path / "plain"), ["id"])
    assert readers.files_below(spark, str(tmp_path / "plain")).count() == 100


def test_stream_drains_restarts_and_conserves(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spoilt = [{"kafka_offset": i} | ({"payload": "[1]"} if i % 3 == 0 else {}) for i in range(30)]
    frame = envelopes(spark, spoilt)
    frame.repartition(3).write.parquet(source)
    counts = lambda: tuple(spark.read.parquet(f"{out}/records").filter(F.col("outcome") == p).count() for p in ("valid", "quarantined"))
    run = lambda: drain(from_files(spark, source, frame.schema, 2), out, state).awaitTermination()
    run()
    assert counts() == (20, 10)
    run()
    assert counts() == (20, 10), "a restart reads nothing again"
    envelopes(spark, [{"kafka_offset": 99}]).write.mode("append").parquet(source)
    run()
    assert counts() == (21, 10)
    assert spark.read.parquet(f"{out}/records").filter("outcome = 'valid'").select("kafka_offset").distinct().count() == 21
    told = accounts(spark, out)
    assert told.count() >= 3 and tuple(told.agg(F.sum("rows"), F.sum("valid"), F.sum("quarantined")).first()) == (31, 21, 10)
    assert GOOD["kafka_offset"] == 1


def test_ledger(spark):
    ledger = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, digest string")
    incoming = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("c", "1", 3), ("c", "1", 4), ("c", "2", 5), (None, "1", 6), (None, "1", 7)], "id string, digest string, n int")
    assert {r["n"]: r["status"] for r in against_ledger(incoming, ledger, "id", "digest", ["n"]).collect()} == {1: "duplicate", 2: "conflict", 3: "new", 4: "duplicate", 5: "conflict", 6: "new", 7: "new"}
    assert {r["status"] for r in against_ledger(incoming, ledger.limit(0), "id", "digest", ["n"]).collect()} == {"new", "duplicate", "conflict"}


def test_refresh_replaces_only_the_last_days(spark, rows, at, tmp_path):
    place = str(tmp_path / "t")
    frame = lambda records: spark.createDataFrame([(at(m), n) for m, n in records], "ts timestamp, n int")
    day = lambda c: F.to_date(c)
    fold = lambda f: f.groupBy(F.to_date("ts").alias("business_date")).agg(F.sum("n").alias("n"))
    fold(frame([("2025-01-01 01:00:00", 1), ("2025-01-05 01:00:00", 1)])).write.partitionBy("business_date").parquet(place)
    refresh(frame([("2025-01-01 01:00:00", 9), ("2025-01-05 01:00:00", 1), ("2025-01-05 02:00:00", 1), ("2025-01-06 02:00:00", 3)]), "ts", day, 2, fold, place)
    assert [(str(d), n) for n, d in rows(spark.read.parquet(place))] == [("2025-01-01", 1), ("2025-01-05", 2), ("2025-01-06", 3)]
    refresh(frame([("2025-01-01 01:00:00", 9)]).limit(0), "ts", day, 2, fold, place)
    with pytest.raises(ValueError):
        refresh(frame([("2025-01-01 01:00:00", 9)]), "ts", day, 0, fold, place)


def test_cooldown_against_a_plain_fold(spark, at):
    import random

    rng = random.Random(1)
    start = at("2025-01-01 00:00:00")
    events = [(rng.choice("ab"), start + timedelta(minutes=rng.randrange(6000)), rng.randrange(4), f"e{i:03d}") for i in range(250)]
    expected, last = set(), {}
    for key, moment, grade, name in sorted(events, key=lambda e: (e[0], e[1], e[3])):
        at_last, grade_last = last.get(key, (None, 0))
        if at_last is None or grade > grade_last or (moment - at_last).total_seconds() >= 6 * 3600:
            expected.add(name)
            last[key] = (moment, grade)
    frame = spark.createDataFrame(events + [(None, start, 1, "x"), ("a", None, 1, "y")], "k string, t timestamp, g int, id string")
    assert {r["id"] for r in alerts(frame, "k", "t", "g", "id", 6 * 3600).collect()} == expected
    assert alerts(frame.limit(0), "k", "t", "g", "id", 1).count() == 0


def test_name_uuids(spark):
    import uuid

    found = spark.createDataFrame([("a",), ("é x",), ("",)], "n string").select("n", name_uuid(str(uuid.NAMESPACE_URL), F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in found)


def test_cooldown_goes_on_over_batches_of_one_stretch(spark, at):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        start = at("2025-01-01 00:00:00")
        events = [("a", start + timedelta(minutes=20 * i), (i * 7) % 5, f"e{i:03d}") for i in range(120)]
        expected, at_last, grade_last = [], None, 0
        for _, moment, grade, name in events:
            if at_last is None or grade > grade_last or (moment - at_last).total_seconds() >= 6 * 3600:
                expected.append(name)
                at_last, grade_last = moment, grade
        frame = spark.createDataFrame(events, "k string, t timestamp, g int, id string")
        assert sorted(r["id"] for r in alerts(frame, "k", "t", "g", "id", 6 * 3600).collect()) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_large_day_has_several_tasks(spark, tmp_path):
    frame = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("event_date"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_by_day(frame, str(tmp_path / "days"), rows_a_task=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "days/event_date=hot").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "days")).distinct().count() == 1000


def test_a_database_is_read_in_parts_by_its_key(spark, rows):
    url = "jdbc:derby:memory:parts;create=true"  # the database that comes with Spark
    frame = spark.createDataFrame([(f"k{i % 37}", i) for i in range(200)], "code string, n int")
    frame.write.jdbc(url, "counted", mode="overwrite")
    read = readers.jdbc_by_hash(spark, url, "counted", '"code"', 3, hash_sql="length({key})")
    assert read.rdd.getNumPartitions() == 3 and rows(read) == rows(frame)
