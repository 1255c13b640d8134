import math
import random
from collections import Counter

import pytest

from ledgerloom.llm.cutting import KINDS, SENTENCE, WORD_END, _kind, cohesion, depths, pieces_of, split
from ledgerloom.llm.tokens import TOKEN

SCHEMA = "doc_id long, text string, piece_no string, cut_at int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], SCHEMA)


def random_text(rng, sentences):
    words = [f"w{i}" for i in range(40)]
    parts = []
    for _ in range(sentences):
        parts.append(" ".join(rng.choices(words, k=rng.randint(3, 40))) + rng.choice([".", "!", "...", ";", ""]) + rng.choice([" ", " ", "\n", "\n\n", ""]))
    return "".join(parts)


def check(text, pieces, limit, overlap):
    spans = [m.span() for m in TOKEN.finditer(text)]
    first, last = {a: i for i, (a, _) in enumerate(spans)}, {b: i + 1 for i, (_, b) in enumerate(spans)}
    before = 0
    for k, (a, b, n, _) in enumerate(pieces):
        assert n == len(TOKEN.findall(text[a:b])) <= limit
        assert first[a] == (before - overlap if k else 0)
        assert last[b] > before
        before = last[b]
    assert before == len(spans)


@pytest.mark.parametrize(("limit", "overlap"), [(256, 32), (64, 8), (20, 0), (9, 4)])
def test_pieces_are_within_the_limit_and_give_the_text_back(limit, overlap):
    rng = random.Random(limit)
    for _ in range(20):
        text = random_text(rng, rng.randint(1, 60))
        check(text, pieces_of(text, limit, overlap), limit, overlap)


def test_the_best_kind_of_gap_is_taken():
    sentence = " ".join("word" for _ in range(9)) + ". "
    paragraphs = "".join(sentence * 3 + "\n\n" for _ in range(30))
    assert {k for *_, k in pieces_of(paragraphs, 100, 10)[:-1]} == {"paragraph"}
    assert {k for *_, k in pieces_of(sentence * 90, 100, 10)[:-1]} == {"sentence"}
    assert {k for *_, k in pieces_of("word " * 900, 100, 10)[:-1]} == {"word"}
    assert {k for *_, k in pieces_of("a-" * 900, 100, 10)[:-1]} == {"inside"}


def test_the_topic_change_is_found():
    rng = random.Random(2)
    topic = lambda letter: "".join(" ".join(rng.choices([f"{letter}{i}" for i in range(12)], k=9)) + ". " for _ in range(17))
    text = topic("a") + topic("b")
    first = pieces_of(text, 256, 32, 40)[0]
    assert text[first[0] : first[1]].endswith(".") and "b" not in text[first[0] : first[1]] and text[first[1] + 1] == "b"


def paragraphs(rng, letter, number):
    """Paragraphs of one topic, each with an end that isn't a topic's end."""
    return "".join("".join(" ".join(rng.choices([f"{letter}{i}" for i in range(9)], k=6)) + ". " for _ in range(2)) + "\n\n" for _ in range(number))


def test_the_deepest_valley_goes_before_other_paragraph_ends():
    rng = random.Random(8)
    for _ in range(20):
        # topics of 154 to 224 tokens: each change lies in the later half of a window
        topics = [paragraphs(rng, letter, rng.randint(11, 16)) for letter in "abcdefg"]
        text = "".join(topics)
        changes, at = set(), 0
        for topic in topics[:-1]:
            at += len(topic)
            changes.add(len(text[:at].rstrip()))
        cuts = [end for _, end, _, _ in pieces_of(text)[:-1]]
        assert sum(c in changes for c in cuts) >= 0.8 * len(cuts)


def test_no_boundary_of_a_window_is_deeper_than_the_one_taken():
    rng = random.Random(9)
    for _ in range(30):
        text = random_text(rng, 60)
        spans = [m.span() for m in TOKEN.finditer(text)]
        terms = [text[a:b].lower() if text[a].isalnum() else None for a, b in spans]
        deep = depths(cohesion(terms))
        number = {b: g for g, (_, b) in enumerate(spans, 1)}
        kind = lambda g: _kind(text[slice(*spans[g - 1])], text[spans[g - 1][1] : spans[g][0]])
        start = fresh = 0
        for first, end, n, name in pieces_of(text)[:-1]:
            window = range(fresh + max(1, (start + 256 - fresh) // 2), start + 257)
            best = number[end]
            natural = [g for g in window if kind(g) <= SENTENCE] or [g for g in window if kind(g) == WORD_END] or list(window)
            assert best in natural and deep[best] == max(deep[g] for g in natural) and name == KINDS[kind(best)]
            fresh, start = best, best - 32


def test_cohesion_and_depths_against_their_definitions():
    rng = random.Random(3)
    terms = [rng.choice(["a", "b", "c", "d", None]) for _ in range(70)]
    found = cohesion(terms, 8)
    for g in range(1, len(terms)):
        x, y = (Counter(t for t in part if t is not None) for part in (terms[max(0, g - 8) : g], terms[g : g + 8]))
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        assert found[g] == pytest.approx(sum(x[t] * y[t] for t in x) / norm if norm else 0.0)
    deep = depths(found, 8)
    for g in range(len(found)):
        assert deep[g] == pytest.approx(max(found[max(0, g - 8) : g + 1]) + max(found[g : g + 9]) - 2 * found[g])


def test_only_long_texts_are_cut_and_rows_say_where(spark):
    long = random_text(random.Random(4), 60)
    texts = [(1, long), (2, "w " * 256), (3, "w " * 257), (4, ""), (5, None), (6, "w" * 5000), (7, "𝔘 😀 é, " * 200), (8, long)]
    found = split(frame(spark, texts)).collect()
    assert {r["doc_id"] for r in found} == {1, 3, 7, 8}
    for i, text in texts:
        own = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["piece_no"])
        if own:
            assert [r["piece_no"] for r in own] == list(range(1, len(own) + 1)) and all(r["piece_text"] == text[r["first_char"] : r["end_char"]] for r in own)
            check(text, [(r["first_char"], r["end_char"], r["piece_size"], r["cut_at"]) for r in own], 256, 32)


def test_very_long_text_and_no_rows(spark):
    found = split(frame(spark, [(1, "one two. " * 100_000)])).collect()
    assert len(found) > 1200 and max(r["piece_size"] for r in found) <= 256
    assert split(frame(spark, [(1, "a")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        split(frame(spark, []), limit=10, overlap=6)
