from ledgerloom.operators import late_events
from ledgerloom.operators.late_events import beyond_cutoff, revisions

SCHEMA = "topic string, place int, event_type string, occurred_at string, recorded_at string, series string, event_day int, beyond string"


def frame(spark, records):
    # series, event_day and beyond clash with names used inside
    return spark.createDataFrame([("t", i, *r, "x", 7, "y") for i, r in enumerate(records)], SCHEMA)


RECORDS = [
    ("a", "2025-01-01T00:00:00Z", "2025-01-01T00:05:00Z"),
    ("a", "2025-01-01T10:00:00Z", "2025-01-04T10:00:00.000Z"),  # exactly the cut-off
    ("a", "2025-01-01T10:00:00Z", "2025-01-04T10:00:00.001Z"),  # a millisecond more
    ("a", "2025-01-01T10:00:00Z", "2025-01-04T10:00:00.001Z"),  # repeated: judged by itself
    ("a", "2025-01-02T01:00:00+03:00", "2025-01-02 00:00:00.000+00:00"),  # of the day before in UTC
    (None, "2025-01-01T00:00:00Z", "2025-02-01T00:00:00-05:00"),
    (None, "2025-01-01T00:00:00Z", "2024-12-31T00:00:00Z"),  # early
    ("a", "2025-01-01T00:00:00", "2025-01-09T00:00:00Z"),  # no zone
    ("a", "2025-13-41T08:00:00Z", "2025-01-09T00:00:00Z"),  # no such day
    ("a", "yesterday", ""),
    ("a", None, "2025-01-09T00:00:00Z"),
    ("a", "2025-01-01T00:00:00Z" * 5000, "2025-01-09T00:00:00Z"),
]


def test_beyond_the_cutoff_to_the_millisecond(spark, rows):
    assert rows(beyond_cutoff(frame(spark, RECORDS), ["topic", "place"])) == [("t", 2), ("t", 3), ("t", 5)]


def test_refused_cells_are_those_of_the_whole_triangle(spark, rows):
    records = frame(spark, RECORDS)
    cells = spark.sql(late_events.triangle_sql("event_type", ["topic", "place"], "occurred_at", "recorded_at", late_events.CUTOFF_MS, 2**40), records=records)
    assert cells.selectExpr("sum(arrived + refused)").first()[0] == 7  # the readable records, those in time included
    refused = cells.filter("refused > 0").selectExpr("series", "event_day", "arrival_day", "arrived", "refused", "array_sort(transform(beyond_rows, r -> r.place)) AS places")
    assert [tuple(map(str, r)) for r in rows(refused)] == [
        ("None", "2025-01-01", "2025-02-01", "0", "1", "[5]"),
        ("a", "2025-01-01", "2025-01-04", "1", "2", "[2, 3]"),
    ]


def test_refused_records_come_from_the_cells(spark, monkeypatch):
    whole = late_events.triangle_sql
    monkeypatch.setattr(late_events, "triangle_sql", lambda *a, **k: f"SELECT * FROM ({whole(*a, **k)}) WHERE series IS NOT NULL")
    assert {r[0] for r in beyond_cutoff(frame(spark, RECORDS), ["place"]).collect()} == {2, 3}


def test_a_hot_cell_has_pieces(spark, rows):
    hot = frame(spark, [RECORDS[2]] * 5000 + [RECORDS[0]] * 5000)
    cells = spark.sql(late_events.triangle_sql("event_type", ["place"], "occurred_at", "recorded_at", late_events.CUTOFF_MS, 100), records=hot)
    assert cells.selectExpr("max(size(beyond_rows))").first()[0] <= 100
    assert rows(beyond_cutoff(hot, ["place"], piece_rows=100)) == rows(spark.range(5000).selectExpr("cast(id AS int)"))


def test_one_scan_and_no_join(spark):
    plan = beyond_cutoff(frame(spark, RECORDS), ["place"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan ") <= 1


def test_every_revision_and_no_refused_record(spark, rows):
    found = rows(revisions(frame(spark, RECORDS)), "event_type", "event_day", "arrival_day", "arrived", "corrected_total", "revision", "is_latest")
    assert [tuple(map(str, r)) for r in found] == [
        ("None", "2025-01-01", "2024-12-31", "1", "1", "1", "True"),
        ("a", "2025-01-01", "2025-01-01", "1", "1", "1", "False"),
        ("a", "2025-01-01", "2025-01-02", "1", "2", "2", "False"),
        ("a", "2025-01-01", "2025-01-04", "1", "3", "3", "True"),
    ]


def test_no_rows_give_none(spark):
    empty = frame(spark, RECORDS).limit(0)
    assert revisions(empty).count() == 0 and beyond_cutoff(empty, ["topic"]).count() == 0


def test_days_are_utc_in_any_session_zone(spark, rows):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert rows(beyond_cutoff(frame(spark, RECORDS), ["place"])) == [(2,), (3,), (5,)]
        assert {str(d) for (d,) in rows(revisions(frame(spark, RECORDS)), "event_day")} == {"2025-01-01"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
