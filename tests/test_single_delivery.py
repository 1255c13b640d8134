import uuid

from ledgerloom.operators.single_delivery import repeated_deliveries, single_deliveries

SCHEMA = "event_id string, kafka_topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, uid string, place string, row int"
PLACE = ["kafka_topic", "kafka_partition", "kafka_offset"]
A, B = "0001dd15-ec04-4eb8-af25-ae8046906f20", "ffff5180-7aa0-436c-98f8-0be183953f5d"


def frame(spark, records):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in records], SCHEMA)


def notations(spark, at):
    one, two = at("2025-01-01 00:00:00"), at("2025-01-02 00:00:00")
    return frame(spark, [
        (A, "t", 0, 5, two), (A.upper(), "t", 0, 6, one), (f"{{{A}}}", "t", 0, 7, None), (A.replace("-", ""), "t", 0, 8, one), (f"urn:uuid:{A}\n", "s", 0, 9, one), (B, "t", 0, 10, two),
        (None, "t", 0, 11, one), (None, "t", 0, 12, one), ("", "t", 0, 13, one), ("n/a", "t", 0, 14, one), ("n/a", "t", 0, 15, one), (A[:-1] + "g", "t", 0, 16, one), (A * 500, "t", 0, 17, one),
    ])


def test_notations_order_and_ties(spark, rows, at):
    found = rows(repeated_deliveries(notations(spark, at), PLACE, order=["kafka_timestamp", *PLACE]))
    # the first: the least time, then topic s before t; unknown times come last
    assert found == [("t", 0, o) for o in (5, 6, 7, 8)]


def test_one_copy_of_each_and_all_columns(spark, rows, at):
    kept = single_deliveries(notations(spark, at))
    assert kept.columns == notations(spark, at).columns
    assert sorted(r["kafka_offset"] for r in kept.collect()) == [9, 10, 11, 12, 13, 14, 15, 16, 17]


def test_stored_and_new_messages_together(spark, rows, at):
    stored = frame(spark, [(A, "t", 0, 1, at("2025-01-01 00:00:00"))])
    new = frame(spark, [(A, "t", 0, 2, at("2025-01-02 00:00:00")), (B, "t", 0, 3, at("2025-01-02 00:00:00"))])
    assert rows(repeated_deliveries(stored, PLACE, new, order=["kafka_timestamp", *PLACE])) == [("t", 0, 2)]
    assert sorted(r["kafka_offset"] for r in single_deliveries(stored, new).collect()) == [1, 3]


def test_a_hot_identifier_is_spread_and_gives_the_same(spark, rows, at):
    hot = [(A, "t", i % 3, i, at("2025-01-01 00:00:00")) for i in range(300)]
    cold = [(str(uuid.UUID(int=i)), "t", 0, 1000 + i, at("2025-01-01 00:00:00")) for i in range(50)] * 2
    records = frame(spark, hot + [(e, t, p, o + 5000 * (i >= 50), m) for i, (e, t, p, o, m) in enumerate(cold)])
    plain = rows(repeated_deliveries(records, PLACE))
    assert len(plain) == 299 + 50
    spread = repeated_deliveries(records, PLACE, rows_a_task=40)
    assert rows(spread) == plain
    assert len(single_deliveries(records, order=PLACE, rows_a_task=40).collect()) == 51


def test_no_rows_give_none(spark, at):
    assert repeated_deliveries(notations(spark, at).limit(0), PLACE).count() == 0 and single_deliveries(notations(spark, at).limit(0)).count() == 0
