import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.spread import _sieve, parted, spread_join


@pytest.mark.parametrize("rare", [False, True])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_keys_give_the_same(spark, rows, how, rare):
    many = spark.createDataFrame([(None if i % 3 == 0 else i % 5, i) for i in range(200)], "k int, i int")
    one = spark.createDataFrame([(None, "none", 67), (1, "one", 27), (2, "two", 26)], "k int, v string, w long")
    plain = rows(spread_join(many, one, ["k"], "w", how))
    assert rows(spread_join(many, one, ["k"], "w", how, rows_a_task=10, rare=rare)) == plain
    assert rows(spread_join(many, one, ["k"], "w", how, rare=rare)) == plain
    expected = {"inner": 0, "left": 200, "left_semi": 0}[how] or sum(1 for i in range(200) if i % 3 == 0 or i % 5 in (1, 2))
    assert len(plain) == expected


def test_nothing_to_join_with(spark):
    many = spark.createDataFrame([(1, 1)], "k int, i int")
    one = spark.createDataFrame([], "k int, v string, w long")
    for rare in (False, True):
        assert spread_join(many, one, ["k"], "w", rare=rare).count() == 0 and spread_join(many, one, ["k"], "w", "left", rare=rare).count() == 1


def test_the_sieve_drops_rows_before_the_shuffle_and_never_a_partner(spark):
    many = spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("i"))
    one = spark.range(0, 200_000, 97).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("w"), (F.col("id") * 2).alias("v"))
    assert sorted(r["v"] for r in spread_join(many, one, ["k"], "w", rare=True).collect()) == [2 * i for i in range(0, 200_000, 97)]
    test, sieve = _sieve(one, ["k"], 2062)
    passed = spark.sql(f"SELECT count(*) AS n FROM {{many}} WHERE {test}", many=many, sieve=sieve).first()["n"]
    assert 2062 <= passed < 5000


def test_parted_rows_are_all_rows_and_keep_partners_near(spark, rows):
    many = spark.range(5000).select((F.col("id") % 1000).cast("string").alias("k"), F.col("id").alias("i")).unionByName(spark.createDataFrame([(None, -1)], "k string, i long"))
    one = spark.range(0, 1000, 50).select(F.col("id").cast("string").alias("k"), F.lit(5).alias("w"))
    near, far = parted(many, one, ["k"])
    assert rows(near.unionByName(far)) == rows(many)
    assert far.join(one, "k").count() == 0 and near.join(one, "k").count() == 100 and near.count() < 400
    near, far = parted(many, one.limit(0), ["k"])
    assert near.count() == 0 and far.count() == 5001
