import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerloom.operators.evaluation import best_blend, boosted_trees, bootstrap_gain, model_rows
from ledgerloom.operators.running import along
from ledgerloom.sources import offsets
from ledgerloom.streaming.cycle import cut_over, run_cycle


def test_along_a_hot_key_against_a_plain_walk(spark):
    rng = random.Random(1)
    records = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(40), i, rng.choice([None, 1, 2, 5])) for i in range(600)]
    frame = spark.createDataFrame(records, "k string, o int, i int, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["i"]: (r["t"], r["p"]) for r in along(frame, ["k"], ["o", "i"], {"t": F.col("n")}, {"p": F.col("n")}).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected, total, before = {}, defaultdict(int), {}
    for k, o, i, n in sorted(records, key=lambda r: (r[1], r[2])):
        total[k] += n or 0
        expected[i] = (total[k], before.get(k))
        before[k] = n
    assert found == expected
    assert along(frame.limit(0), ["k"], ["o"], {"t": F.col("n")}).count() == 0


def test_bootstrap_interval_repeats_and_holds_the_mean(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(2.0, 3.0, 2000)
    frame = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)] + [("x", None)], "id string, g double")
    one, two = bootstrap_gain(frame, "id", "g").first(), bootstrap_gain(frame.repartition(5), "id", "g").first()
    assert one["low"] == pytest.approx(two["low"]) and one["high"] == pytest.approx(two["high"])
    spread = 1.96 * values.std() / 2000**0.5
    assert one["mean_gain"] == pytest.approx(values.mean()) and one["low"] == pytest.approx(values.mean() - spread, abs=0.05) and one["high"] == pytest.approx(values.mean() + spread, abs=0.05)


def test_best_blend(spark):
    frame = spark.createDataFrame([(0.3 * a + 0.7 * b, a, b) for a, b in [(1.0, 5.0), (4.0, 2.0), (8.0, 3.0)]], "y double, m double, b double")
    found = best_blend(frame, "y", "m", "b").first()
    assert found["share"] == 0.3 and found["error"] == pytest.approx(0, abs=1e-9)


def test_boosted_trees_predict_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(float(x), float(z), 3.0 * x if z > 5 else -x, float(x * z > 20)) for x, z in ((rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(1500))]
    frame = spark.createDataFrame(rows, "x double, z double, y double, c double")
    train, test = frame.filter("x * 1000 % 10 < 8"), frame.filter("x * 1000 % 10 >= 8")
    error = boosted_trees(train, ["x", "z"], "y").transform(test).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert error < 2.0
    scored = boosted_trees(train, ["x", "z"], "c", most_rows=1000, classify=True).transform(test).withColumn("p", F.element_at(vector_to_array("probability"), 2))
    assert scored.agg(F.avg((F.col("p") - F.col("c")) ** 2)).first()[0] < 0.08


def test_few_distinct_features_are_sampled_by_row(spark):
    # 3 combinations among 60,000 rows, 100 times the bound; every third row twice
    rate = {1.0: 0.1, 2.0: 0.5, 3.0: 0.9}
    once = spark.range(45_000).select(F.concat(F.lit("r"), "id").alias("id"), (F.col("id") % 3 + 1).cast("double").alias("x"), F.lit(1.0).alias("z"), (F.floor(F.col("id") / 3) % 10).alias("tenth"))
    rows = once.unionByName(once.filter("x = 1")).withColumn("c", (F.col("tenth") < F.element_at(F.array(*map(F.lit, rate.values())), F.col("x").cast("int")) * 10).cast("double"))
    for row_id in (["id"], None):
        drawn = model_rows(rows, ["x", "z"], 600, row_id)
        sides = {(r["x"], r["row_seen"]): r["count"] for r in drawn.groupBy("x", "row_seen").count().collect()}
        assert len(sides) == 6 and 450 < sum(sides.values()) < 750
    twice = model_rows(rows, ["x", "z"], 600, ["id"]).groupBy("id").agg(F.count_distinct("row_seen").alias("sides"))
    assert twice.agg(F.max("sides")).first()[0] == 1
    scored = boosted_trees(rows, ["x", "z"], "c", most_rows=600, classify=True, rounds=3, row_id=["id"]).transform(once.filter("tenth = 0").limit(30))
    for r in scored.groupBy("x").agg(F.avg(F.element_at(vector_to_array("probability"), 2)).alias("p")).collect():
        assert r["p"] == pytest.approx(rate[r["x"]], abs=0.2)


def topic(spark, n):
    return spark.createDataFrame([("a", p, o, f"{p}-{o}") for p in (0, 1) for o in range(n)], "kafka_topic string, kafka_partition int, kafka_offset long, id string")


def test_cycles_go_on_and_never_count_twice(spark, tmp_path):
    manifest, folder = tmp_path / "offsets.json", str(tmp_path / "deltas")
    offsets.write_json(manifest, {"a": {"0": 0}})
    low, high = {"a": {"0": 0, "1": 0}}, {"a": {"0": 30, "1": 30}}
    done = [run_cycle(spark, topic(spark, 30), manifest, low, high, folder, "id", 25) for _ in range(4)]
    assert [d["records"] for d in done] == [25, 25, 10, 0] and offsets.read_manifest(manifest) == high
    assert spark.read.parquet(folder).select("id").distinct().count() == spark.read.parquet(folder).count() == 60
    offsets.write_json(manifest, done[0]["offsets"])  # as if the second cycle had broken off before it counted
    assert run_cycle(spark, topic(spark, 30), manifest, low, high, folder, "id", 25)["batch"] == done[1]["batch"]
    assert spark.read.parquet(folder).count() == 60


def test_cycles_stop_at_gaps_and_short_batches(spark, tmp_path):
    manifest = tmp_path / "offsets.json"
    offsets.write_json(manifest, {"a": {"0": 0, "1": 0}})
    with pytest.raises(RuntimeError, match="gone"):
        run_cycle(spark, topic(spark, 30), manifest, {"a": {"0": 5, "1": 0}}, {"a": {"0": 30, "1": 30}}, str(tmp_path / "d"), "id")
    with pytest.raises(RuntimeError, match="of 80"):
        run_cycle(spark, topic(spark, 30), manifest, {"a": {"0": 0, "1": 0}}, {"a": {"0": 40, "1": 40}}, str(tmp_path / "d"), "id")
    assert offsets.read_manifest(manifest) == {"a": {"0": 0, "1": 0}}


def test_cut_over_catches_up(spark):
    places = iter([{"a": {"0": 3}}, {"a": {"0": 7}}])
    asked = []
    taken, after = cut_over(lambda: next(places), lambda: "snapshot", lambda a, b: asked.append((a, b)) or "changes", lambda s, c: (s, c))
    assert taken == ("snapshot", "changes") and after == {"a": {"0": 7}} and asked == [({"a": {"0": 3}}, {"a": {"0": 7}})]
