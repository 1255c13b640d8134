import random

import pytest

from ledgerloom.operators.evaluation import chosen_threshold, exact_metrics, exact_points


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "c int, p double")


def scored(spread, n=3000):
    """Rare positives whose scores, all under 0.0005, tell them by ``spread``; some are tied."""
    rng = random.Random(5)
    pairs = [(int(rng.random() < 0.03), rng.random()) for _ in range(n)]
    return [(c, round((p + c * spread) / 4000, 6 if i % 3 else 12)) for i, (c, p) in enumerate(pairs)]


def points(pairs):
    """(score, precision, recall, alert rate, F2) of each distinct score."""
    hits = sum(c for c, _ in pairs)
    for s in sorted({p for _, p in pairs}):
        taken = [c for c, p in pairs if p >= s]
        precision, recall = sum(taken) / len(taken), sum(taken) / hits
        yield s, precision, recall, len(taken) / len(pairs), 5 * precision * recall / (4 * precision + recall) if recall else 0.0


def test_very_small_scores_are_not_ties(spark):
    pairs = scored(0.4)
    found = exact_metrics(exact_points(frame(spark, [*pairs, (None, 0.5), (1, None), (1, float("nan"))]), "c", "p")).first()
    good, bad = [p for c, p in pairs if c], [p for c, p in pairs if not c]
    prevalence = len(good) / len(pairs)
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    at = {s: precision for s, precision, *_ in points(pairs)}
    average = sum(at[g] for g in good) / len(good)
    top = sorted(pairs, key=lambda x: -x[1])[:300]
    edge = [c for c, p in pairs if p == top[-1][1]]
    in_top = sum(c for c, p in top if p > top[-1][1]) + sum(edge) / len(edge) * sum(p == top[-1][1] for _, p in top)
    assert found["scored"] == 3000 and found["roc_auc"] == pytest.approx(auc, abs=1e-6) and auc > 0.6
    assert found["average_precision"] == pytest.approx(average, abs=1e-6) and found["average_precision_lift"] == pytest.approx(average / prevalence, abs=1e-5)
    assert found["top_precision"] == pytest.approx(in_top / 300, abs=1e-6) and found["top_lift"] == pytest.approx(in_top / 300 / prevalence, abs=1e-5)


def test_the_threshold_with_the_greatest_f2(spark):
    pairs = scored(0.9)
    prevalence = sum(c for c, _ in pairs) / len(pairs)
    fit = [(f2, precision / prevalence, -rate, s) for s, precision, recall, rate, f2 in points(pairs) if recall >= 0.5 and precision / prevalence >= 1.5 and rate <= 0.1]
    f2, lift, rate, score = max(fit)
    found = chosen_threshold(exact_points(frame(spark, pairs), "c", "p")).first()
    assert found["selection"] == "operating_point" and found["threshold"] == pytest.approx(score, abs=1e-9)
    assert (found["f2"], found["lift"], found["alert_rate"]) == pytest.approx((f2, lift, -rate), abs=1e-6)


def test_else_the_90th_percentile(spark):
    pairs = scored(0.0)
    order = sorted(p for _, p in pairs)
    threshold = order[2699] + (order[2700] - order[2699]) * 0.1
    found = chosen_threshold(exact_points(frame(spark, pairs), "c", "p")).first()
    assert found["selection"] == "top_tenth" and found["threshold"] == pytest.approx(threshold, abs=1e-9)
    assert found["alert_rate"] == pytest.approx(sum(p >= threshold for _, p in pairs) / 3000, abs=1e-6)


def test_no_scores_and_no_positives(spark):
    assert chosen_threshold(exact_points(frame(spark, []), "c", "p")).count() == 0
    none = chosen_threshold(exact_points(frame(spark, [(0, 0.1), (0, 0.2), (0, 0.3)]), "c", "p")).first()
    assert none["selection"] == "top_tenth" and none["threshold"] == pytest.approx(0.28) and none["recall"] is None
