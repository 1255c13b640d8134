"""Figures on predictions, and splits in time that keep labels from reaching across."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .running import along

#: Values that a draw by hash can have.
_DRAWS = 2**53


def exact_percentiles(rows: DataFrame, group: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles of a column per group, between two values where the place falls between them: one column a point.

    Values are counted first; running counts along a range-partitioned sort give their places, so that neither one group
    nor all values meet in a task. Null values don't count.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    run = cut(along(counts, group, ["value"], {"until": F.col("n")}))  # read for the sizes and again beside them
    sizes = run.groupBy(*[F.col(g).alias(f"of_{g}") for g in group]).agg(F.max("until").alias("size"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    placed = run.join(sizes if group else F.broadcast(sizes), same)  # one row without a group
    since = F.col("until") - F.col("n")

    def at(share: float) -> Column:
        place = (F.col("size") - 1) * share
        value_at = lambda p: F.max(F.when((since <= p) & (p < F.col("until")), F.col("value")))
        low, high = value_at(F.floor(place)), value_at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return placed.groupBy(*group).agg(*[at(share).alias(name) for name, share in points.items()])


def regression_metrics(rows: DataFrame, truth: str, prediction: str, group: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R2, WAPE, sMAPE, median and 90th percentile of the error, and bias, per group if given."""
    group = group or []
    y, p = F.col("truth"), F.col("prediction")
    error = F.col("error")
    known = rows.select(*group, F.col(truth).cast("double").alias("truth"), F.col(prediction).cast("double").alias("prediction")).dropna(subset=["truth", "prediction"]).withColumn("error", F.abs(y - p))
    points = exact_percentiles(known, group, "error", {"median_error": 0.5, "p90_error": 0.9})
    figures = known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(error), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        F.round(1.0 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(F.lit(1))), 6).alias("r2"),
        F.round(F.sum(error) / F.greatest(F.sum(F.abs(y)), F.lit(1.0)), 6).alias("wape"),
        F.round(F.avg(2.0 * error / F.greatest(F.abs(y) + F.abs(p), F.lit(1e-9))), 6).alias("smape"),
        (F.round(F.avg(p - y), 6) + 0.0).alias("bias"),
    )
    points = points.select(*[F.col(g).alias(f"of_{g}") for g in group], F.round("median_error", 6).alias("median_error"), F.round("p90_error", 6).alias("p90_error"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    joined = figures.join(points if group else F.broadcast(points), same, "left")
    return joined.select(*group, *[c for c in ("n", "mae", "rmse", "r2", "wape", "smape", "median_error", "p90_error", "bias")])


def score_table(rows: DataFrame, truth: str, score: str, steps: int = 1000) -> DataFrame:
    """Positives and rows by score, rounded to ``steps`` levels between 0 and 1: what all binary figures need."""
    level = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double"))) * steps).cast("int")
    known = rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(truth).cast("long")).alias("positives"))


def operating_points(scores: DataFrame) -> DataFrame:
    """Per level of a score table: recall, precision, alert rate, F2 if all from it on are taken. At most 1,001 rows."""
    down = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    run = scores.withColumns({"taken": F.sum("n").over(down), "hits": F.sum("positives").over(down), "rows": F.sum("n").over(whole), "all_positives": F.sum("positives").over(whole)})
    precision, recall = F.col("hits") / F.col("taken"), F.try_divide(F.col("hits"), F.col("all_positives"))
    f2 = F.try_divide(5.0 * precision * recall, 4.0 * precision + recall)
    return run.select("level", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.col("taken") / F.col("rows"), 6).alias("alert_rate"), F.round(f2, 6).alias("f2"))


def binary_metrics(scores: DataFrame, steps: int = 1000) -> DataFrame:
    """Prevalence, area under ROC (ties count half), average precision, Brier score and calibration error in ten bins."""
    down = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    run = scores.withColumns({"taken": F.sum("n").over(down), "hits": F.sum("positives").over(down), "rows": F.sum("n").over(whole), "all_positives": F.sum("positives").over(whole)})
    score = F.col("level") / F.lit(float(steps))
    negatives = F.col("rows") - F.col("all_positives")
    under = F.col("taken") - F.col("hits")  # negatives at or above
    beaten = F.col("positives") * (negatives - under + (F.col("n") - F.col("positives")) * 0.5)
    brier = F.col("positives") * (1.0 - score) * (1.0 - score) + (F.col("n") - F.col("positives")) * score * score
    figures = run.agg(
        F.round(F.sum("positives") / F.sum("n"), 6).alias("prevalence"), F.round(F.try_divide(F.sum(beaten), F.max(F.col("all_positives") * negatives)), 6).alias("roc_auc"),
        F.round(F.sum(F.try_divide(F.col("positives"), F.col("all_positives")) * F.col("hits") / F.col("taken")), 6).alias("average_precision"), F.round(F.sum(brier) / F.sum("n"), 6).alias("brier"),
    )
    bins = scores.withColumn("bin", F.least(F.floor(score * 10), F.lit(9))).groupBy("bin").agg(F.sum("n").alias("n"), F.abs(F.sum(score * F.col("n")) - F.sum("positives")).alias("gap"))
    return figures.join(bins.agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("calibration_error")))


def exact_points(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Per distinct score between 0 and 1: its rows and positives, all from it on, all at all, and what taking them gives.

    Scores aren't rounded, so there may be as many as rows; the running sums go along a range-partitioned sort. Scores
    beyond 0 and 1 count as these, NaN as no score. Without positives recall is null, as are the figures made of it.
    """
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double"))) + 0.0
    known = rows.filter(F.col(truth).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counts = known.groupBy(clipped.alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(truth).cast("long")).alias("positives"))
    run = along(counts.withColumn("from_top", -F.col("score")), [], ["from_top"], {"taken": F.col("n"), "hits": F.col("positives")}).drop("from_top")
    run = cut(run)  # read for the sums and again beside them
    whole = run.agg(F.sum("n").alias("rows"), F.sum("positives").alias("all_positives"))  # one row
    precision, recall = F.col("hits") / F.col("taken"), F.try_divide(F.col("hits"), F.col("all_positives"))
    f2 = F.try_divide(5.0 * precision * recall, 4.0 * precision + recall)
    prevalence = F.greatest(F.col("all_positives") / F.col("rows"), F.lit(1e-9))
    return run.join(F.broadcast(whole)).withColumns({"prevalence": prevalence, "precision": precision, "recall": recall, "alert_rate": F.col("taken") / F.col("rows"), "lift": precision / prevalence, "f2": F.when(recall == 0, 0.0).otherwise(f2)})


def exact_metrics(points: DataFrame) -> DataFrame:
    """The figures of binary_metrics() over distinct scores, with the lift of average precision and of the top 10 %.

    The top has a tenth of the rows, cut down to a whole number, one at least; of rows with the score at its end it takes
    each alike, so that its share of their positives counts.
    """
    negatives = F.col("rows") - F.col("all_positives")
    over = F.col("taken") - F.col("n")
    beaten = F.col("positives").cast("double") * (negatives - (F.col("taken") - F.col("hits")) + (F.col("n") - F.col("positives")) * 0.5)
    brier = F.col("positives") * (1.0 - F.col("score")) * (1.0 - F.col("score")) + (F.col("n") - F.col("positives")) * F.col("score") * F.col("score")
    top = F.greatest(F.lit(1), F.floor(F.col("rows") / 10))
    in_top = F.col("positives") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top - over) / F.col("n")))
    precision = F.sum(F.try_divide(F.col("positives"), F.col("all_positives")) * F.col("precision"))
    figures = points.agg(
        F.sum("n").alias("scored"), F.round(F.sum("positives") / F.sum("n"), 6).alias("prevalence"), F.round(F.try_divide(F.sum(beaten), F.max(F.col("all_positives").cast("double") * negatives)), 6).alias("roc_auc"),
        F.round(precision, 6).alias("average_precision"), F.round(precision / F.max("prevalence"), 6).alias("average_precision_lift"), F.round(F.sum(brier) / F.sum("n"), 6).alias("brier"),
        F.round(F.sum(in_top) / F.max(top), 6).alias("top_precision"), F.round(F.try_divide(F.sum(in_top), F.max("all_positives")), 6).alias("top_recall"), F.round(F.sum(in_top) / F.max(top) / F.max("prevalence"), 6).alias("top_lift"),
    )
    bins = points.withColumn("bin", F.least(F.floor(F.col("score") * 10), F.lit(9))).groupBy("bin").agg(F.sum("n").alias("n"), F.abs(F.sum(F.col("score") * F.col("n")) - F.sum("positives")).alias("gap"))
    return figures.join(bins.agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("calibration_error")))  # one row each


#: The least lift of precision by prevalence below which it holds; the last beyond.
LIFTS = ((0.005, 5.0), (0.02, 3.0))
COMMON_LIFT = 1.5


def chosen_threshold(points: DataFrame, least_recall: float = 0.5, most_alerts: float = 0.1) -> DataFrame:
    """One row: the score from which on to alert, by exact_points(), and what it gives; none for no scores.

    Of the scores with enough recall and lift and not too many alerts, the one of the greatest F2, then lift, then the
    fewest alerts. If there is none, the 90th percentile of the scores, between two of them if need be.
    """
    needed = F.lit(COMMON_LIFT)
    for below, lift in reversed(LIFTS):
        needed = F.when(F.col("prevalence") < below, lift).otherwise(needed)
    fits = (F.col("recall") >= least_recall) & (F.col("lift") >= needed) & (F.col("alert_rate") <= most_alerts)
    at = (F.col("rows") - 1) * 0.9  # place among the scores in order, from 0
    before = F.col("rows") - F.col("taken")
    holds = lambda place: F.max(F.when((before <= place) & (place < before + F.col("n")), F.col("score")))
    best = F.max(F.when(fits, F.struct("f2", "lift", -F.col("alert_rate"), "score")))
    ends = points.agg(best["score"].alias("best"), holds(F.floor(at)).alias("low"), holds(F.ceil(at)).alias("high"), F.max(at - F.floor(at)).alias("between"))
    between = F.col("low") + (F.col("high") - F.col("low")) * F.col("between")
    chosen = ends.select(F.coalesce("best", between).alias("threshold"), F.when(F.col("best").isNotNull(), "operating_point").otherwise("top_tenth").alias("selection"))
    # the least score at or over the threshold has the figures of all that are
    reached = points.join(F.broadcast(chosen), F.col("score") >= F.col("threshold")).groupBy("threshold", "selection").agg(F.min_by(F.struct("precision", "recall", "alert_rate", "lift", "f2"), "score").alias("p"))
    return reached.select("selection", F.round("threshold", 9).alias("threshold"), *[F.round(F.col("p")[c], 6).alias(c) for c in ("precision", "recall", "alert_rate", "lift", "f2")])


def time_split(rows: DataFrame, day: str, embargo_days: int, train: float = 0.6, validation: float = 0.8) -> DataFrame:
    """Rows with ``part``: train, validation, test by the days that occur, or purged: a label could reach the next part."""
    days = rows.select(day).filter(F.col(day).isNotNull()).distinct()
    # one row: the borders among all days that occur, in order
    borders = days.agg(F.sort_array(F.collect_set(day)).alias("all")).select(
        F.element_at("all", F.greatest(F.lit(1), F.floor(F.size("all") * train)).cast("int")).alias("train_end"),
        F.element_at("all", F.greatest(F.greatest(F.lit(1), F.floor(F.size("all") * train)) + 1, F.floor(F.size("all") * validation)).cast("int")).alias("validation_end"),
    )
    part: Column = (
        F.when(F.col(day) > F.col("validation_end"), "test")
        .when((F.col(day) > F.col("train_end")) & (F.col(day) <= F.date_sub("validation_end", embargo_days)), "validation")
        .when(F.col(day) <= F.date_sub("train_end", embargo_days), "train")
        .otherwise("purged")
    )
    return rows.join(F.broadcast(borders)).withColumn("part", part).drop("train_end", "validation_end")


def bootstrap_gain(rows: DataFrame, row_id: str, gain: str, repetitions: int = 200, seed: int = 42) -> DataFrame:
    """Mean of ``gain`` with the 2.5 and 97.5 percent points of its bootstrap, as one row.

    Each row has a Poisson weight for each repetition, drawn from its id and the seed, so that tasks draw apart, results
    repeat, and only a sum and a weight a repetition and task are gathered.
    """
    known = rows.filter(F.col(gain).isNotNull()).select(F.xxhash64(F.col(row_id), F.lit(seed)).alias("h"), F.col(gain).cast("double").alias("gain"))
    steps = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(12)])

    def partial(batches):
        sums = np.zeros((2, repetitions))
        mixed = (np.arange(1, repetitions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for batch in batches:
            values = batch["gain"].to_numpy()
            for at in range(0, len(values), 4096):
                h = batch["h"].to_numpy()[at : at + 4096].astype(np.int64).view(np.uint64)[:, None] ^ mixed
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                weight = np.searchsorted(steps, (h >> np.uint64(11)).astype(np.float64) / 2.0**53)
                sums[0] += values[at : at + 4096] @ weight
                sums[1] += weight.sum(axis=0)
        yield pd.DataFrame({"repetition": np.arange(repetitions), "total": sums[0], "weight": sums[1]})

    each = known.mapInPandas(partial, "repetition int, total double, weight double").groupBy("repetition").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("mean"))
    ends = each.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return known.agg(F.avg("gain").alias("mean_gain")).join(ends)  # one row each


def best_blend(rows: DataFrame, truth: str, model: str, baseline: str, steps: int = 20) -> DataFrame:
    """The share of the model in a mix with a baseline that has the least mean absolute error, and that error; one pass."""
    y, m, b = (F.col(c).cast("double") for c in (truth, model, baseline))
    errors = rows.filter(y.isNotNull() & m.isNotNull() & b.isNotNull()).agg(*[F.avg(F.abs(y - (m * (k / steps) + b * (1 - k / steps)))).alias(f"e{k}") for k in range(steps + 1)])
    each = F.array(*[F.struct(F.round(f"e{k}", 9).alias("error"), F.lit(k / steps).alias("share")) for k in range(steps + 1)])
    return errors.select(F.array_min(each).alias("best")).select("best.share", "best.error")


def model_rows(known: DataFrame, features: list[str], most_rows: int, row_id: list[str] | None = None, seed: int = 42) -> DataFrame:
    """About ``most_rows`` of the rows at most, each drawn by itself, with ``row_seen``: true for eight in ten, drawn apart.

    The draws come from the hash of ``row_id`` (the features beside it tell rows without one apart), so a row delivered
    again falls on the same side. Without ``row_id`` the rows are written and numbered. Equal features are never drawn as one.
    """
    if row_id is None:
        known, row_id = cut(known).withColumn("row_number", F.monotonically_increasing_id()), ["row_number"]
    n = known.count()
    draw = lambda *more: F.pmod(F.xxhash64(*row_id, *features, *more), F.lit(_DRAWS))
    drawn = known.filter(draw() < _DRAWS * most_rows // n) if n > most_rows else known
    return drawn.withColumn("row_seen", draw(F.lit(seed)) < _DRAWS // 10 * 8)


def boosted_trees(labelled: DataFrame, features: list[str], label: str, most_rows: int = 200_000, classify: bool = False, rounds: int = 20, seed: int = 42, row_id: list[str] | None = None):
    """A gradient-boosted tree model with its features assembled; fitted on at most about ``most_rows`` rows by their hash.

    The bound is the only sampling: the model then scores any number of rows. ``classify`` adds a logistic calibration of
    the trees' margin (Platt), fitted on the rows that the trees didn't see. ``row_id`` names the columns that tell rows
    apart, see model_rows().
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    kept = list(dict.fromkeys([*features, label, *(row_id or [])]))
    known = labelled.dropna(subset=[*features, label]).select(*kept).withColumn(label, F.col(label).cast("double"))
    known = model_rows(known, features, most_rows, row_id, seed)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    if not classify:
        return Pipeline(stages=[assembler, GBTRegressor(labelCol=label, maxIter=rounds, seed=seed)]).fit(known)
    trees = Pipeline(stages=[assembler, GBTClassifier(labelCol=label, maxIter=rounds, seed=seed, predictionCol="leaning").setRawPredictionCol("margin").setProbabilityCol("uncalibrated")]).fit(known.filter("row_seen"))
    calibration = LogisticRegression(featuresCol="margin", labelCol=label).fit(trees.transform(known.filter("NOT row_seen")))
    return PipelineModel(stages=[*trees.stages, calibration])
