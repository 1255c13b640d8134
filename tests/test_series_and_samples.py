import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import finite, half_up, normal_cdf, rate
from ledgerloom.operators.allocation import from_lots, largest_remainder
from ledgerloom.operators.catalogue import first_of_key, normalised
from ledgerloom.operators.evaluation import binary_metrics, exact_percentiles, operating_points, regression_metrics, score_table, time_split
from ledgerloom.operators.quality import broken_rules, null_counts, orphans, repeated_keys
from ledgerloom.operators.ranking import ranked, tile
from ledgerloom.operators.sampling import top_of_each, within_budget
from ledgerloom.operators.series import ahead, back, dense, forward_filled, strict

D0 = date(2025, 1, 1)


def day(k):
    return D0 + timedelta(days=k)


def test_dense_grid_windows_and_tails(spark):
    daily = spark.createDataFrame([("a", day(0), 4), ("a", day(3), 6), ("b", day(9), 1)], "e string, day date, n long")
    grid = dense(daily, ["e"], "day", ["n"])
    assert grid.count() == 20
    before, after = back(["e"], "day", 3), ahead(["e"], "day", 3)
    made = {(r["e"], r["day"]): r for r in grid.select("*", F.sum("n").over(before).alias("b"), F.sum("n").over(after).alias("f"), strict(F.sum("n").over(after), after, 3).alias("s")).collect()}
    assert made["a", day(0)]["b"] is None and made["a", day(3)]["b"] == 4 and made["a", day(0)]["f"] == 6
    assert made["b", day(8)]["f"] == 1 and made["b", day(8)]["s"] is None and made["b", day(9)]["f"] is None, "tails are cut short, strict ones are null"


def test_forward_fill(spark):
    frame = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 4, None)], "e string, day int, v int")
    assert [r[0] for r in frame.withColumn("f", forward_filled("v", ["e"], "day")).orderBy("e", "day").select("f").collect()] == [None, 5, 5, None]


def test_budget_takes_whole_histories_in_hash_order(spark):
    import hashlib

    rng = random.Random(1)
    sizes = {f"k{i}": rng.randint(1, 9) for i in range(200)}
    frame = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "k string, i int")
    order, total, expected = sorted(sizes, key=lambda k: hashlib.md5(k.encode()).hexdigest()), 0, set()
    for k in order:
        total += sizes[k]
        if total <= 100:
            expected.add(k)
    taken = within_budget(frame, ["k"], 100, F.col("k")).collect()
    assert {r["k"] for r in taken} == expected and len(taken) == sum(sizes[k] for k in expected)
    assert {r["k"] for r in within_budget(frame, ["k"], 0, F.col("k")).collect()} == {order[0]}, "the first always"


def test_top_of_each(spark, rows):
    frame = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), (None, 5)], "b string, i int")
    assert rows(top_of_each(frame, "b", [F.col("i")], 2)) == [(None, 5), ("a", 1), ("a", 2)]


def test_ranks_and_tiles(spark):
    values = [random.Random(2).randrange(50) for _ in range(203)]
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(5)
    found = ranked(frame, "v", "i").withColumn("t", tile(F.col("rank"), F.col("rank_count"), 4)).collect()
    assert [r["rank"] for r in sorted(found, key=lambda r: (r["v"], r["i"]))] == list(range(1, 204)) and found[0]["rank_count"] == 203
    assert [sum(r["t"] == k for r in found) for k in (1, 2, 3, 4)] == [51, 51, 51, 50]
    assert ranked(frame.limit(0), "v").count() == 0


def test_lots_serve_requests_in_order(spark):
    rng = random.Random(3)
    asked = [(f"r{i:02d}", k, i, rng.choice([None, 0, 1, 2, 7])) for k in "ab" for i in range(12)]
    held = [(f"l{i:02d}", k, i, rng.randint(0, 6)) for k in "abc" for i in range(9)]
    requests, lots = spark.createDataFrame(asked, "request string, key string, t int, n long"), spark.createDataFrame(held, "lot string, key string, e int, m long")
    found = {(r["key"], r["request"], r["lot"]): r["units"] for r in from_lots(requests, lots, ["key"], ["t"], ["e"], "request", "lot", "n", "m").collect()}
    expected = {}
    for k in "ab":
        left = {lot: m for lot, key, _, m in held if key == k}
        for request, key, _, n in asked:
            n = n or 0 if key == k else 0
            for lot in sorted(left):
                take = min(n, left[lot])
                if take:
                    expected[k, request, lot] = take
                    n, left[lot] = n - take, left[lot] - take
    assert found == expected


def test_largest_remainder(spark):
    frame = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0), ("g", "c", 1.0), ("h", "d", None), ("h", "e", -2.0)], "g string, k string, w double")
    found = {r["k"]: r["share"] for r in largest_remainder(frame, "k", "w", 10, 1, ["g"]).collect()}
    assert found == {"a": 3, "b": 3, "c": 4, "d": 1, "e": 1}, "ties go to the greatest key; without weight only the least"


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 20, 300).astype(float), rng.integers(0, 20, 300).astype(float)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)] + [(None, 1.0), (1.0, None)], "y double, p double")
    found = regression_metrics(frame, "y", "p").first()
    e = np.abs(y - p)
    for name, value in {"n": 300, "mae": e.mean(), "rmse": (e * e).mean() ** 0.5, "r2": 1 - (e * e).sum() / ((y - y.mean()) ** 2).sum(), "wape": e.sum() / y.sum(), "median_error": np.median(e), "p90_error": np.quantile(e, 0.9), "bias": (p - y).mean()}.items():
        assert found[name] == pytest.approx(value, abs=2e-6)


def test_binary_metrics_against_definitions(spark):
    rng = np.random.default_rng(2)
    score = rng.integers(0, 11, 200) / 10
    truth = (rng.random(200) < score).astype(int)
    table = score_table(spark.createDataFrame([(int(t), float(s)) for t, s in zip(truth, score)], "t int, s double"), "t", "s")
    found = binary_metrics(table).first()
    pairs = [(a > b) + 0.5 * (a == b) for a in score[truth == 1] for b in score[truth == 0]]
    assert found["roc_auc"] == pytest.approx(np.mean(pairs), abs=1e-6) and found["brier"] == pytest.approx(((score - truth) ** 2).mean(), abs=1e-6)
    for r in operating_points(table).collect():
        taken = score >= r["level"] / 1000 - 1e-9
        assert r["precision"] == pytest.approx(truth[taken].mean(), abs=1e-6) and r["recall"] == pytest.approx(truth[taken].sum() / truth.sum(), abs=1e-6) and r["alert_rate"] == pytest.approx(taken.mean(), abs=1e-6)


def test_split_in_time_purges_what_reaches_across(spark):
    frame = spark.createDataFrame([(day(k),) for k in range(100)] * 2, "day date")
    found = {r["part"]: (r["n"], r["a"], r["b"]) for r in time_split(frame, "day", 7).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("b")).collect()}
    assert found == {"train": (106, day(0), day(52)), "validation": (26, day(60), day(72)), "test": (40, day(80), day(99)), "purged": (28, day(53), day(79))}


def test_checks(spark, rows):
    frame = spark.createDataFrame([(1, "a", 2), (1, "a", None), (2, None, -1), (None, "z", 0), (None, "z", 0)], "k int, c string, n int")
    assert rows(null_counts(frame, ["k", "n"])) == [("k", 2), ("n", 1)]
    assert rows(repeated_keys(frame, ["k"])) == [(None, 2), (1, 2)]
    assert rows(orphans(frame, "c", spark.createDataFrame([("a",)], "id string"), "id")) == [("z", 2)]
    assert rows(broken_rules(frame, {"positive": F.col("n") > 0, "known": F.col("k").isNotNull()})) == [("known", 2), ("positive", 4)]


def test_catalogue(spark, rows):
    frame = spark.createDataFrame([(3, " Abc  x ", "M", " oral ", 1.0), (1, "ABC X", "m", ".", 2.0), (2, "  ", "M", None, 1.0), (4, "d", None, "a", 1.0), (5, "d", "m", "a", 0.0)], "id int, name_en string, made_by string, way string, price double")
    made = normalised(frame, "name_en", "made_by", "way", "price")
    assert {r["id"]: (r["match_key"], r["reject_reason"], r["route"]) for r in made.collect()} == {3: ("abc x|m", None, "ORAL"), 1: ("abc x|m", None, "UNKNOWN"), 2: ("|m", "no_name", "UNKNOWN"), 4: ("d|", "no_maker", "A"), 5: ("d|m", "no_price", "A")}
    assert rows(first_of_key(made.filter("reject_reason IS NULL"), "match_key", ["id"], ["name"])) == [("abc x|m", "ABC X", 2)]


def test_numbers(spark):
    frame = spark.createDataFrame([(1.0, 0.0), (2.0, 3.0), (float("nan"), 1.0), (float("inf"), 1.0), (None, None)], "a double, b double")
    assert [r[0] for r in frame.select(rate(F.col("a"), F.col("b"))).collect()][:2] == [None, 0.666667]
    assert [r[0] for r in frame.select(finite(F.col("a"))).collect()] == [1.0, 2.0, 0.0, 0.0, 0.0]
    from statistics import NormalDist

    xs = [-6, -2.5, -1, -0.1, 0, 0.3, 1.96, 5]
    found = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - NormalDist().cdf(r["x"])) < 1e-7 for r in found)
    assert str(spark.range(1).select(half_up(F.lit("2.345").cast("decimal(10,3)"), 2)).first()[0]).startswith("2.35")


def test_trend_has_the_first_days_of_least_and_greatest_demand(spark):
    from ledgerloom.plans.serving_queries import _trend

    days = [("2025-03-01", 5, 4), ("2025-03-02", 9, 9), ("2025-03-03", 2, 1), ("2025-03-04", 9, 3), ("2025-03-05", 2, 2), ("2025-03-06", None, None), ("2025-03-07", 6, 3)]
    frame = spark.createDataFrame(days, "business_date string, requested_units long, fulfilled_units long").withColumn("business_date", F.to_date("business_date"))
    found = _trend(frame).first()
    assert (found["least_day"], found["least_units"], found["greatest_day"], found["greatest_units"]) == ("2025-03-03", 2, "2025-03-02", 9)
    assert (found["days"], found["change"], found["least_fill"], found["greatest_fill"]) == (7, 1, 0.333333, 1.0)
    assert _trend(frame.limit(0)).first()["least_day"] is None


def test_percentiles_lie_between_values(spark):
    rng = np.random.default_rng(3)
    values = {g: rng.integers(0, 50, n).astype(float) for g, n in (("a", 1), ("b", 2), ("c", 101), (None, 60))}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    found = {r["g"]: (r["low"], r["high"]) for r in exact_percentiles(frame, ["g"], "v", {"low": 0.5, "high": 0.9}).collect()}
    assert found == {g: (np.percentile(vs, 50), pytest.approx(np.percentile(vs, 90))) for g, vs in values.items()}
    whole = np.concatenate(list(values.values()))
    (row,) = exact_percentiles(frame, [], "v", {"low": 0.25}).collect()
    assert row["low"] == pytest.approx(np.percentile(whole, 25))


def test_requests_of_one_key_take_time_in_proportion(spark):
    import time

    def seconds(n):
        requests = spark.range(n).selectExpr("'k' AS k", "id AS r", "1L AS units")
        lots = spark.range(n // 10).selectExpr("'k' AS k", "id AS l", "9L AS units")
        began = time.perf_counter()
        (row,) = from_lots(requests, lots, ["k"], [], [], "r", "l", "units", "units").selectExpr("count(*) AS n", "sum(units) AS units").collect()
        assert row["units"] == n // 10 * 9 and row["n"] >= n // 10 * 9
        return time.perf_counter() - began

    seconds(2_000)
    small, large = seconds(20_000), seconds(160_000)
    assert large < 8 * small + 5


def test_shares_of_groups_with_null_keys_and_ties(spark):
    rows = [(None, "a", 1.0), (None, "b", 1.0), (None, "c", 1.0), ("x", "a", None), ("x", "b", -1.0), ("y", "a", 0.5)]
    frame = spark.createDataFrame(rows, "g string, k string, w double")
    found = {(r["g"], r["k"]): r["share"] for r in largest_remainder(frame, "k", "w", 10, 1, ["g"]).collect()}
    assert found == {(None, "a"): 3, (None, "b"): 3, (None, "c"): 4, ("x", "a"): 1, ("x", "b"): 1, ("y", "a"): 10}
    whole = largest_remainder(spark.range(1000).selectExpr("id AS k", "1.0D AS w"), "k", "w", 1500)
    assert whole.selectExpr("sum(share)", "min(share)", "max(share)").first()[:] == (1500, 1, 2)
    assert largest_remainder(frame.limit(0), "k", "w", 10).count() == 0
