import datetime as dt
import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from ledgerloom.operators.known_time import Forest, _split, known_at

T0 = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
EVENTS = "event_id string, product string, ts timestamp, entity string, moment int"
HISTORY = "obs string, product string, price double, observed timestamp, loaded timestamp, valid int, known int"
ARGS = ("event_id", "product", "ts", "obs", "price", "observed", "loaded")


def hours(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def frames(spark, events, history):
    return spark.createDataFrame([(e, p, hours(t), "x", 1) for e, p, t in events], EVENTS), spark.createDataFrame([(o, p, v, hours(a), hours(b), 1, 1) for o, p, v, a, b in history], HISTORY)


def brute(events, history):
    found = set()
    for e, p, t in events:
        if None in (e, p, t):
            continue
        known = [(a, b, o) for o, q, v, a, b in history if q == p and None not in (v, a, b, o) and a <= t and b <= t]
        if known:
            found.add((e, max(known)[2]))
    return sorted(found)


def made(seed, products=6, observations=80, events=300):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.05 else x
    history = [(f"o{i:04d}", maybe(f"p{rng.randrange(products)}"), maybe(1.0), maybe(rng.randrange(40)), maybe(rng.randrange(60))) for i in range(observations)]
    asked = [(f"e{i % (events - 20)}", f"p{i % (events - 20) % (products + 1)}", (i % (events - 20)) % 70) for i in range(events)]
    return asked + [(None, "p1", 3), ("n1", None, 3), ("n2", "p1", None)], history


def test_broadcast_forest_against_brute_force(spark, rows):
    for seed in (1, 2):
        events, history = made(seed)
        assert rows(known_at(*frames(spark, events, history), *ARGS)) == brute(events, history)


def test_shards_with_hot_entities_give_the_same(spark, rows):
    events, history = made(3)
    events += [(f"hot{i}", "p1", i % 50) for i in range(400)]
    assert rows(known_at(*frames(spark, events, history), *ARGS, forest_rows=20, events_a_group=60)) == brute(events, history)


def test_an_entity_beyond_a_shard_is_cut_by_time(spark, rows):
    for seed in (6, 7):
        events, history = made(seed, products=2, observations=300, events=400)
        history += [(f"late{i:03d}", "p1", 1.0, i % 40, 55) for i in range(60)]  # learned at one late moment
        events += [(f"hot{i}", "p1", i % 70) for i in range(300)]
        expected = brute(events, history)
        assert rows(known_at(*frames(spark, events, history), *ARGS, forest_rows=15, events_a_group=50)) == expected


def test_no_group_holds_more_history_than_a_forest(spark):
    events, history = made(8, products=1, observations=400)
    asked, told = frames(spark, events, history)
    micros = lambda c: F.unix_micros(c)
    asked = asked.select(F.col("event_id").alias("event"), F.col("product").alias("entity"), micros("ts").alias("moment")).dropna()
    told = told.filter("price IS NOT NULL").select(F.col("product").alias("entity"), micros("observed").alias("valid"), micros("loaded").alias("known"), F.col("obs").alias("observation")).dropna()
    _, sharded = _split(asked, told, 4, 10)
    assert sharded.groupBy("shard", "stretch").count().agg(F.max("count")).first()[0] <= 11


def test_ties_go_to_the_later_load_then_the_greater_id(spark, rows):
    history = [("a", "p", 1.0, 1, 5), ("b", "p", 1.0, 1, 6), ("c", "p", 1.0, 1, 6), ("d", "p", 1.0, 1, 9), ("e", "p", None, 3, 3)]
    assert rows(known_at(*frames(spark, [("x", "p", 6), ("y", "p", 9), ("z", "p", 4), ("x", "p", 6)], history), *ARGS)) == [("x", "c"), ("y", "d")]


def test_empty_tables(spark):
    events, history = made(4)
    assert known_at(*frames(spark, events, history[:0] or [("a", "p", None, 1, 1)]), *ARGS).count() == 0
    asked, told = frames(spark, events, history)
    assert known_at(asked.limit(0), told, *ARGS).count() == 0 and known_at(asked, told.limit(0), *ARGS).count() == 0


def test_every_version_of_the_forest_stays(at):
    rng = np.random.default_rng(5)
    n = 500
    entity, valid, known = pa.array([f"p{i}" for i in rng.integers(0, 7, n)]), rng.integers(0, 100, n), rng.integers(0, 100, n)
    ids = pa.array([f"{i:05d}" for i in range(n)])
    forest = Forest(entity, valid.astype(np.int64), known.astype(np.int64), ids)
    for p in range(8):
        for t in range(-1, 101, 7):
            held = [(valid[i], known[i], ids[i].as_py()) for i in range(n) if entity[i].as_py() == f"p{p}" and valid[i] <= t and known[i] <= t]
            found = forest.lookup(pa.array([f"p{p}"]), np.array([t]))[0]
            assert (forest.ids[found].as_py() if found >= 0 else None) == (max(held)[2] if held else None)
