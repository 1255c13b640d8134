import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa

from ledgerloom.llm.leakage import SHINGLE, _by_size, _shingle_hashes, _word_hashes, first_minima, leaks, signatures, windows_like

DOCS, ITEMS = "doc_id long, text string, text_tgt string, item_id string", "item_id long, text string, doc_id string"


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)


def plain(text):
    shown = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", shown).casefold()))


def brute(docs, items, passage=12):
    held = defaultdict(set)
    for item, text in items:
        own = plain(text or "")
        n = min(passage, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            held[tuple(own[i : i + n])].add(item)
    found = set()
    for doc, text in docs:
        own = plain(text or "")
        for n in {len(k) for k in held}:
            for i in range(len(own) - n + 1):
                found |= {(doc, item) for item in held.get(tuple(own[i : i + n]), ())}
    return sorted(found)


def test_typography_thresholds_and_parts(spark, rows):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = [(1, long), (2, "Alpha beta gamma delta epsilon zeta eta theta"), (3, "a b"), (4, ""), (5, None), (6, "…"), (7, long)]
    docs = [
        (1, "x ONE, two; three four five\nsix se­ven eight nine​ ten eleven TWELVE y"),  # twelve words
        (2, "one two three four five six seven eight nine ten eleven"),  # one short
        (3, "three four five six seven eight nine ten eleven twelve thirteen fourteen"),  # the last twelve
        (4, "one two three four five six x seven eight nine ten eleven twelve"),  # broken
        (5, "ﬁrst: ＡＬＰＨＡ beta-gamma_delta (epsilon) zeta eta theta."), (6, "alpha beta gamma delta epsilon zeta eta"), (7, "A... B!"), (8, ""), (9, None), (10, "b a"),
    ]
    found = rows(leaks(*frames(spark, docs, items)))
    assert found == sorted(brute(docs, items), key=str)
    assert {d for d, _ in found} == {1, 3, 5, 7} and {i for d, i in found if d == 1} == {1, 7}


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 8, 11, 12, 13, 40]))) for i in range(30)]
    docs = []
    for d in range(120):
        body = text(rng.randint(0, 80)).split()
        if rng.random() < 0.5:
            own = rng.choice(items)[1].split()
            first = rng.randint(0, max(0, len(own) - 12))
            body[rng.randint(0, len(body)) :] += own[first : first + rng.randint(11, 14)]
        docs.append((d, " ".join(body)))
    return docs, items


def test_against_brute_force(spark, rows):
    for seed in (1, 2):
        docs, items = random_case(seed)
        assert rows(leaks(*frames(spark, docs, items))) == sorted(brute(docs, items), key=str)


def test_passages_beyond_a_broadcast_and_hot_ones_give_the_same(spark, rows):
    docs, items = random_case(3)
    docs += [(5, docs[5][1])]  # a repeated row
    docs += [(1000 + i, items[0][1]) for i in range(200)]  # an item that leaks everywhere
    expected = sorted(brute(docs, items), key=str)
    assert rows(leaks(*frames(spark, docs, items))) == expected
    assert rows(leaks(*frames(spark, docs, items), broadcast_bytes=0, rows_a_task=20)) == expected


def test_passages_of_equal_shingles_are_told_apart(spark, rows):
    items = [(1, "a b a b a b a b a b a b"), (2, "b a b a b a b a b a b a")]
    docs = [(1, "a b a b a b a b a b a b"), (2, "x b a b a b a b a b a b a x"), (3, "a b a b a b a b a b a b a")]
    assert rows(leaks(*frames(spark, docs, items))) == [(1, 1), (2, 2), (3, 1), (3, 2)]


def test_minima_and_signatures_against_their_definitions():
    rng = random.Random(11)
    hashed = _word_hashes([f"w{rng.randint(0, 20)}" for _ in range(60)])
    for size, least, each in first_minima(hashed, [1, 3, 5, 6, 9, 12]):
        q = min(SHINGLE, size)
        whole = _shingle_hashes(hashed, q)
        assert (each == whole).all() and len(least) == 61 - size
        assert all(least[i] == whole[i : i + size - q + 1].min() for i in range(len(least)))
        alone = [signatures(e, m, np.arange(1), size)[0] for i in range(len(least)) for _, m, e in first_minima(hashed[i : i + size], [size])]
        assert (signatures(each, least, np.arange(len(least)), size) == alone).all()
    assert all(len(m) == 0 for size, m, _ in first_minima(hashed[:3], [4, 5, 12]))


def test_the_search_alone_finds_every_window_and_few_others():
    docs, items = random_case(5)
    held = {tuple(own[i : i + n]) for _, t in items for own in [plain(t)] for n in [min(12, len(own))] for i in range(len(own) - n + 1)}
    classes = sorted({len(p) for p in held})
    first, signed = np.zeros(2**10, dtype=np.uint64), np.zeros(2**10, dtype=np.uint64)
    for p in held:
        ((_, least, each),) = first_minima(_word_hashes(list(p)), [len(p)])
        for sieve, key in ((first, int(least[0])), (signed, int(signatures(each, least, np.arange(1), len(p))[0]))):
            for by in (0, 24):
                place = (key >> by) % (len(sieve) * 64)
                sieve[place >> 6] |= np.uint64(1 << (place & 63))
    found = {(d, w) for d, _, _, w in windows_like([t for _, t in docs], classes, first, signed)}
    true = {(d, " ".join(own[i : i + n])) for d, (_, t) in enumerate(docs) for own in [plain(t)] for n in classes for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in held}
    assert true <= found, "recall of the search, before any check, is 1"
    assert len(found) <= 1.2 * len(true) + 20


def test_documents_are_read_once_whatever_the_items(spark):
    docs, items = frames(spark, *random_case(6))
    for most in (10**8, 0):
        plan = leaks(docs, items, broadcast_bytes=most)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") <= 1


def test_a_passage_deep_inside_a_very_long_text(spark, rows):
    passage = " ".join(f"p{i}" for i in range(12))
    body = " ".join(f"x{i % 977}" for i in range(300_000))
    assert rows(leaks(*frames(spark, [(1, f"{body} {passage} {body}")], [(9, f"lead {passage} tail")]))) == [(1, 9)]


def test_empty_tables(spark):
    docs, items = frames(spark, *random_case(4))
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_batches_are_searched_in_slices_that_keep_all_rows():
    texts = ["a" * 7, None, "", "b" * 30, "c", "dd", "e" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    parts = [p.column(1).to_pylist() for p in _by_size(batch, 10)]
    assert [x for p in parts for x in p] == texts and all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in parts)
    assert list(_by_size(batch.slice(0, 0), 10)) == []
