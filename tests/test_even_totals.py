from decimal import Decimal

from ledgerloom.operators.even_totals import heavy_keys, key_totals, totals_once

SCHEMA = "id string, product string, amount decimal(16,2), quantity int, key_value string, row_count int"


def frame(spark, records):
    return spark.createDataFrame([(i, p, Decimal(a) if a is not None else None, q, "clash", 1) for i, p, a, q in records], SCHEMA)


RECORDS = [("1", "p", "1.10", 1), ("1", "p", "1.10", 1), ("2", "p", None, 2), (None, "p", "3.00", 1), (None, "p", "3.00", 1), ("3", None, "9.00", 1), ("4", "q", None, None)]


def test_totals_as_delivered_and_once(spark, rows):
    assert rows(key_totals(frame(spark, RECORDS), "product", ["amount", "quantity"])) == [("p", 5, Decimal("8.20"), 6), ("q", 1, None, None)]
    assert rows(totals_once(frame(spark, RECORDS), "product", ["amount", "quantity"], "id")) == [("p", 4, Decimal("7.10"), 5), ("q", 1, None, None)]


def test_heavy_keys_count_null_keys_in_the_whole(spark, rows):
    records = [(str(i), "hot" if i < 4 else None if i < 50 else f"k{i}", "1", 1) for i in range(100)]
    assert rows(heavy_keys(frame(spark, records), "product", 25)) == [("hot", 4)]
    assert rows(heavy_keys(frame(spark, records + [("x", None, "1", 1)]), "product", 25)) == []


def test_no_rows_give_none(spark):
    empty = frame(spark, RECORDS).limit(0)
    assert key_totals(empty, "product", ["amount"]).count() == 0 and heavy_keys(empty, "product", 25).count() == 0


def test_partial_aggregates_come_before_the_shuffle(spark):
    plan = key_totals(frame(spark, RECORDS), "product", ["amount"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning")  # the tree is printed from its root
