"""What the plans of the large queries must and must not have."""

import re
from pathlib import Path

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="the test tables aren't here")


def plan(spark, name):
    """The plan of a query, after those of what it wrote on its way."""
    of = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    kind, texts = type(spark.range(1)), []
    write = kind.checkpoint
    kind.checkpoint = lambda self, *a, **k: texts.append(of(self)) or write(self, *a, **k)
    try:
        return "\n".join([of(__spark_entry__.queries()[name](spark, FOLDER)), *texts][::-1])
    finally:
        kind.checkpoint = write


def read_columns(text):
    return {tuple(sorted(re.findall(r"(\w+):", schema))) for schema in re.findall(r"ReadSchema: struct<([^>]*)>?", text)}


@pytest.mark.parametrize(("name", "unread"), [("p4_found", "payload"), ("p2_found", "payload"), ("p3_found", "correlation_id"), ("p5_found", "net_sales_egp"), ("p6_found", "outcome"), ("q_daily_branch_demand", "correlation_id"), ("ag_16_header_rollup", "tax_treatment")])
def test_only_needed_columns_are_read(spark, name, unread):
    columns = read_columns(plan(spark, name))
    assert columns and not any(unread in c for c in columns)


@pytest.mark.parametrize("name", ["p2_revisions", "p3_found", "p3_trailing_totals", "p4_found", "p5_found", "p5_sales_totals", "mart_product_daily_performance", "jn_19_order_lifecycle", "stm_08_reconciled_snapshot", "stm_09_current_state_overlay", "stm_10_event_dispositions", "alg_01_requests_from_lots"])
def test_no_pairs_are_tried(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["p2_revisions", "p3_trailing_totals", "p5_found", "q_daily_branch_demand", "mart_product_daily_performance", "fct_daily_sales_demand", "jn_01_star_enrich"])
def test_rows_are_folded_before_they_move(spark, name):
    assert "partial_" in plan(spark, name)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "flt_01_validation_codes", "stm_08_reconciled_snapshot", "q_dfeat_demand_features", "mart_product_daily_performance"])
def test_no_python_in_the_plan(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


def test_a_filter_on_a_table_reaches_its_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,sale\.units_fulfilled\)", plan(spark, "fct_daily_sales_demand"))


def test_coverage_of_loads_is_compared_and_written(spark, monkeypatch):
    from ledgerloom.plans import core_problems

    written, cut = [], core_problems.cut
    monkeypatch.setattr(core_problems, "cut", lambda df: written.append(cut(df)) or written[-1])
    core_problems.p1_found(spark, FOLDER)
    (loads,) = [df for df in written if {"shift_before", "shift_overall", "out_of_order"} <= set(df.columns)]
    assert loads.count() and loads.filter("shift_overall IS NULL").count() == 0


def written_and_last(spark, name):
    """The plans of what a query wrote on its way, in order, and its last one."""
    texts = []
    kind = type(spark.range(1))
    write = kind.checkpoint
    kind.checkpoint = lambda self, *a, **k: texts.append(self._jdf.queryExecution().executedPlan().toString()) or write(self, *a, **k)
    try:
        last = __spark_entry__.queries()[name](spark, FOLDER)
    finally:
        kind.checkpoint = write
    return [*texts, last._jdf.queryExecution().executedPlan().toString()]


@pytest.mark.parametrize("name", ["p4_found", "p4_single_deliveries", "stm_10_event_dispositions"])
def test_identifiers_are_counted_by_hash_before_anything_is_ranked(spark, name):
    counted = written_and_last(spark, name)[0]
    assert "FileScan" in counted and "HashAggregate" in counted and "SortAggregate" not in counted and "min(" not in counted


def test_refused_records_come_from_one_scan_without_a_join(spark):
    (only,) = written_and_last(spark, "p2_found")
    assert only.count("FileScan") == 1 and "Join" not in only


def test_totals_move_only_partial_sums(spark):
    (only,) = written_and_last(spark, "p5_sales_totals")
    assert only.count("Exchange hashpartitioning") == 2 and only.count("partial_sum") >= 2


def test_lots_are_shared_out_without_looking_ahead(spark):
    assert not any("unboundedfollowing" in text.lower() for text in written_and_last(spark, "alg_01_requests_from_lots"))
