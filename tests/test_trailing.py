import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.operators.trailing import idle_days, trailing_totals

SCHEMA = "id string, product string, ts timestamp, units int, day string, day_total string, entity int"


def frame(spark, records):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in records], SCHEMA)


def totals(spark, records, record_id="id"):
    return trailing_totals(frame(spark, records), "product", "ts", "units", (7, 30), record_id)


def test_days_without_activity_and_repeats(spark, rows, at):
    records = [
        ("1", "p", at("2025-01-01 00:00:00"), 5), ("1", "p", at("2025-01-01 00:00:00"), 5), ("2", "p", at("2025-01-01 23:59:59.999999"), 2), (None, "p", at("2025-02-05 00:00:00"), 1), (None, "p", at("2025-02-05 00:00:00"), 1),
        ("3", None, at("2025-01-01 00:00:00"), 9), ("4", "p", None, 9), ("5", "p", at("2025-01-01 00:00:00"), None), ("6", "q", at("2025-01-03 00:00:00"), 4),
    ]
    found = {(r["product"], str(r["day"])): r for r in totals(spark, records).collect()}
    assert len(found) == 36 + 1
    assert found["p", "2025-01-01"]["day_total"] == 7 and found["p", "2025-02-05"]["day_total"] == 2
    assert found["p", "2025-01-07"]["total_7d"] == 7 and found["p", "2025-01-08"]["total_7d"] == 0
    assert found["p", "2025-01-30"]["total_30d"] == 7 and found["p", "2025-01-30"]["average_30d"] == round(7 / 30, 6)
    idle = rows(idle_days(totals(spark, records), "product", 30))
    assert [str(d) for _, d in idle] == [f"2025-{m:02d}-{d:02d}" for m, d in [(1, 31), (2, 1), (2, 2), (2, 3), (2, 4)]]


def test_no_rows_give_none(spark, at):
    assert totals(spark, [("1", None, None, None)]).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 50), st.integers(-3, 9)), min_size=1, max_size=40))
def test_against_brute_force(spark, events):
    start = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
    records = [(str(i), p, start + dt.timedelta(days=d, hours=3), n) for i, (p, d, n) in enumerate(events)]
    by = defaultdict(lambda: defaultdict(int))
    for p, d, n in events:
        by[p][d] += n
    expected = {(p, d): (sum(by[p][k] for k in range(d - 6, d + 1) if k in by[p]), sum(by[p][k] for k in range(d - 29, d + 1) if k in by[p])) for p in list(by) for d in range(min(by[p]), max(by[p]) + 1)}
    found = {(r["product"], (r["day"] - start.date()).days): (r["total_7d"], r["total_30d"]) for r in totals(spark, records).collect()}
    assert found == expected
