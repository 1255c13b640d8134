import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm.packing import best_fit_decreasing, least_containers, pack
from ledgerloom.llm.tokens import TOKEN, size

SCHEMA = "doc_id long, text string, size string, container_id int, item_id string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in texts], SCHEMA)


def check(found, texts, capacity):
    fill, total = Counter(), defaultdict(int)
    for r in found:
        fill[r["container_id"]] += r["size"]
        total[r["doc_id"]] += r["size"]
    expected = defaultdict(int)
    for i, t in texts:
        if t is not None:
            expected[i] += len(TOKEN.findall(t))
    assert total == expected and max(fill.values(), default=0) <= capacity
    whole = Counter(r["doc_id"] for r in found)
    stands = Counter(i for i, _ in texts)
    assert all(n == stands[i] for i, n in whole.items() if expected[i] <= capacity)
    return len(fill)


def random_texts(n, longest, seed=1):
    rng = random.Random(seed)
    return [(i, "a " * rng.randint(1, longest)) for i in range(n)]


@pytest.mark.parametrize(("n", "longest", "a_partition"), [(400, 60, 50), (400, 99, 30), (300, 250, 100)])
def test_every_text_once_and_near_the_bound(spark, n, longest, a_partition):
    texts = random_texts(n, longest)
    found = pack(frame(spark, texts).repartition(6), capacity=100, items_a_partition=a_partition).collect()
    used = check(found, texts, 100)
    sizes = []
    for _, t in texts:
        whole, last = divmod(len(TOKEN.findall(t)), 100)
        sizes += [100] * whole + [last] * bool(last)
    bound = least_containers(np.array(sizes), 100)
    assert bound <= used <= bound * 1.08 + 2


def test_empty_null_long_and_repeated_texts(spark):
    texts = [(1, ""), (2, None), (3, "b " * 1050), (4, "c"), (4, "c"), (5, "…!?"), (6, " \n ")]
    found = pack(frame(spark, texts), capacity=100).collect()
    check(found, texts, 100)
    assert Counter(r["doc_id"] for r in found) == {1: 1, 3: 11, 4: 2, 5: 1, 6: 1}
    assert sorted(r["piece_no"] for r in found if r["doc_id"] == 3) == list(range(1, 12))


def test_no_documents(spark):
    assert pack(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_a_round_never_adds_containers(spark):
    texts = random_texts(200, 70, 3)
    counts = [len({r["container_id"] for r in pack(frame(spark, texts).repartition(5), capacity=100, items_a_partition=20, rounds=k).collect()}) for k in (1, 2, 4)]
    assert counts[0] >= counts[1] >= counts[2]


def test_rounds_go_on_until_nothing_is_gained(spark):
    texts = random_texts(300, 70, 4)
    count = lambda **k: len({r["container_id"] for r in pack(frame(spark, texts).repartition(30), capacity=100, items_a_partition=30, **k).collect()})
    assert count() <= min(count(rounds=k) for k in (1, 2, 4))


def fewest(sizes, capacity):
    """The number of containers of the best packing, by trying all."""
    best = [len(sizes)]

    def put(k, spaces):
        if len(spaces) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(spaces)
            return
        for j, s in enumerate(spaces):
            if s >= sizes[k]:
                put(k + 1, [*spaces[:j], s - sizes[k], *spaces[j + 1 :]])
        put(k + 1, [*spaces, capacity - sizes[k]])

    put(0, [])
    return best[0]


def test_bounds_and_packing_against_the_best():
    rng = random.Random(7)
    reached = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 8))), reverse=True)
        best, bound = fewest(sizes, 30), least_containers(np.array(sizes), 30)
        assigned, opened = best_fit_decreasing(np.array(sizes), 30)
        assert bound <= best <= opened and max(np.bincount(assigned, weights=sizes)) <= 30
        reached += bound == best
    assert reached > 50


def test_sizes_are_those_of_the_public_tokenizer(spark):
    texts = ["", "don't stop!?", "Straße_1 ½ ٣ 漢字かな", "a b c\x1cd\x85e", "éé — «x»…", "𝔘𝔫𝔦 😀😀 x​y", "a" * 100_000, "\n\t "]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", size("t").alias("n")).collect()
    assert {r["i"]: r["n"] for r in found} == {i: len(TOKEN.findall(t)) for i, t in enumerate(texts)}
