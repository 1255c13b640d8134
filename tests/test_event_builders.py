import json
from uuid import UUID, uuid5

from pyspark.sql import functions as F

from ledgerloom.operators import event_builders as eb
from ledgerloom.plans.event_queries import snk_12_keyed_events

D, B, P, M, R, O, C = (f"{i}0000000-0000-4000-8000-000000000000" for i in range(1, 8))
ROW = {"demand_id": D, "basket_id": R, "branch_id": B, "product_id": P, "movement_id": M, "receipt_id": R, "purchase_order_id": O, "procurement_cycle_id": C, "supplier_id": B, "channel": "x", "fulfillment_status": "FULL", "expected_delivery_on": "2025-01-09", "occurred_at": "2025-01-01T00:00:00Z", "ordered_at": "2025-01-02T00:00:00Z", "received_at": "2025-01-03T00:00:00Z"}
NUMBERS = ["requested_quantity", "fulfilled_quantity", "lost_quantity", "quantity_delta", "on_hand_before", "on_hand_after", "inventory_version_after", "available_quantity", "reorder_point", "target_stock_level", "recommended_reorder_quantity", "inventory_version", "line_count", "ordered_units", "received_units"]


def frame(spark, **changed):
    row = ROW | dict.fromkeys(NUMBERS, 3) | changed
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if k in NUMBERS else 'string'}" for k in row))


def event(name):
    return str(uuid5(UUID(eb.EVENTS), name))


def test_events_of_six_kinds_are_linked(spark):
    sale, order, receipt, restock = (event(x) for x in (f"sale.units_fulfilled|{D}", f"purchase_order.created|{O}", f"goods_receipt.received|{R}", f"restock.applied|{M}"))
    moved, stock = event(f"inventory.quantity_changed|{M}"), str(uuid5(UUID(eb.INVENTORY), f"{B}|{P}"))
    expected = {
        "sale_events": (sale, D, D, None), "sale_inventory_events": (moved, stock, D, sale), "reorder_events": (event(f"inventory.reorder_required|{D}|{P}"), stock, D, moved),
        "purchase_order_events": (order, O, C, None), "receipt_events": (receipt, R, C, order), "restock_events": (restock, stock, C, receipt), "restock_inventory_events": (event(f"inventory.quantity_changed|restock|{M}"), stock, C, restock),
    }
    kinds = set()
    for name, ids in expected.items():
        made = getattr(eb, name)(frame(spark)).first()
        assert (made["event_id"], made["aggregate_id"], made["correlation_id"], made["causation_id"]) == ids, name
        kinds.add(made["event_type"])
    assert len(kinds) == 6
    assert eb.sale_events(frame(spark, fulfilled_quantity=0)).count() == 0
    assert eb.reorder_events(frame(spark, movement_id=None)).first()["causation_id"] is None


def test_keyed_events_are_correlated(spark, tmp_path):
    moment = F.to_timestamp(F.lit("2025-01-01T00:00:00Z"))
    attempt = spark.range(1).select(F.lit(D).alias("demand_attempt_id"), F.lit(R).alias("linked_sale_id"), F.lit(B).alias("branch_id"), F.lit(P).alias("product_id"), moment.alias("transaction_ts"), F.lit(3).alias("requested_units"), F.lit(2).alias("fulfilled_units"), F.lit(1).alias("lost_units"), F.lit("PARTIAL").alias("outcome"))
    attempt.write.parquet(str(tmp_path / "demand_attempt.parquet"))
    found = snk_12_keyed_events(spark, str(tmp_path)).first()
    value = json.loads(found["value"])
    assert found["key"] == value["correlation_id"] == D and value["event_id"] == event(f"sale.units_fulfilled|{D}") and value["payload"]["fulfilled_quantity"] == 2


def test_decisions_of_models(spark):
    body = {"stage": "7K.5", "model_key": "reorder_recommendation", "prediction_event_id": "p", "model_version": "1", "branch_id": " b ", "product_id": "q", "action_required": True, "recommended_order_units": 2.1, "probability": "NaN"}
    topics = {name: f"chain.{topic}" for name, topic in zip(("s", "r", "e"), eb.DECISIONS, strict=True)}
    cases = [("r", body), ("r", body | {"recommended_order_units": -1}), ("r", body | {"model_key": "stockout_risk"}), ("s", body | {"model_key": "stockout_risk", "severity": "high"}), ("e", body | {"model_key": "expiry_slow_moving_risk", "batch_id": "x"}), ("e", body | {"model_key": "expiry_slow_moving_risk"}), ("r", body | {"stage": "7"}), ("?", body), ("r", [1])]
    messages = spark.createDataFrame([(i, topics.get(t, t), json.dumps(v)) for i, (t, v) in enumerate(cases)], "i int, topic string, value string")
    found = [tuple(r) for r in eb.decided(messages).orderBy("i").select("decision_error", "decision_type", "entity_key", "recommended_units", "action_required", "severity", "probability").collect()]
    assert found[0] == (None, "REORDER", "b|q", 3, True, "WATCH", None) and found[1] == (None, "REORDER", "b|q", 0, False, "NORMAL", None)
    assert found[3] == (None, "STOCKOUT", "b|q", None, True, "HIGH", None) and found[4] == (None, "EXPIRY", "x", None, True, "HIGH", None)
    assert [f[0] for f in found] == [None, None, "topic_model_mismatch", None, None, "missing_entity", "unsupported_stage", "unsupported_topic", "payload_not_object"]
