"""Ranking metrics of scored samples (label, score and group columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import ratio


def _offsets(counted: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
    """Samples and positives in the higher, and negatives in the lower values of column `at` within `by`; columns start with `name`."""
    found = counted.groupBy(*by, at).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    higher = Window.partitionBy(*by).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = (("seen", F.sum("n").over(higher)), ("hits", F.sum("p").over(higher)), ("below", F.sum(F.col("n") - F.col("p")).over(lower)))
    return found.select(*[F.col(c).alias(f"{name}_{c}") for c in (*by, at)], *[F.coalesce(x, F.lit(0)).alias(f"{name}_{k}") for k, x in sums])


def _per_score(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Samples and positives of each distinct score with those above and below; ties are one step.

    Scores are dealt into ranges of 1/1024, and those into narrow ones of 1/2^20: sums run within a
    narrow range, and those of the ranges before are added, so that a split with as many scores as
    samples isn't one task, even where its scores lie close together.
    """
    counted = (
        scored.groupBy(*by, "score")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
        .withColumns({"_range": F.floor(F.col("score") * 1024), "_narrow": F.floor(F.col("score") * 2**20)})
    )
    within = [*by, "_range"]
    ranges, narrow = _offsets(counted, list(by), "_range", "_r"), _offsets(counted, within, "_narrow", "_n")
    offsets = narrow.join(F.broadcast(ranges), [F.col(f"_n_{c}").eqNullSafe(F.col(f"_r_{c}")) for c in within])
    same = [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in (*within, "_narrow")]
    falling = Window.partitionBy(*within, "_narrow").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rising = Window.partitionBy(*within, "_narrow").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.col(f"_r_{name}") + F.col(f"_n_{name}")
    return (
        counted.join(offsets, same)
        .withColumn("_seen", before("seen") + F.sum("n").over(falling))
        .withColumn("_hits", before("hits") + F.sum("p").over(falling))
        .withColumn("_below", before("below") + F.coalesce(F.sum(F.col("n") - F.col("p")).over(rising), F.lit(0)))
        .select(*by, "score", "n", "p", "_seen", "_hits", "_below")
    )


def _pr_auc() -> Column:
    return F.round(F.try_divide(F.sum(F.col("p") * F.col("_hits") / F.col("_seen")), F.sum("p").cast("double")), 6).alias("pr_auc")


def _roc_auc() -> Column:
    negative = F.col("n") - F.col("p")
    area = F.sum(F.col("p") * (F.col("_below") + negative / 2.0))
    return F.round(F.try_divide(area, F.sum("p").cast("double") * F.sum(negative)), 6).alias("roc_auc")


def _f1(threshold: float) -> Column:
    hit = F.col("score") >= threshold
    true = F.count_if(hit & (F.col("label") == 1))
    return F.round(ratio(2 * true, F.count_if(hit) + F.count_if(F.col("label") == 1)), 6).alias("f1")


def average_precision(scored: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """pr_auc as step-wise average precision; null without positives."""
    return _per_score(scored, by).groupBy(*by).agg(_pr_auc())


def roc_auc(scored: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """roc_auc, tied scores counting half; null with one class only."""
    return _per_score(scored, by).groupBy(*by).agg(_roc_auc())


def f1_at_threshold(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("split",)) -> DataFrame:
    """f1 of scores at or above a threshold; 0 where undefined."""
    return scored.groupBy(*by).agg(_f1(threshold))


def top_k_metrics(scored: DataFrame, fraction: float = 0.1, by: Sequence[str] = ("split",)) -> DataFrame:
    """recall_at_k and precision_at_k of the ceil(n * fraction) best scores, at least one; ties by sample_id.

    Only scores at the cut are ranked one by one: counts per score show where it lies.
    """
    best = _per_score(scored, by)
    whole = best.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * F.lit(fraction))).alias("_k"), F.sum("p").alias("_all"))
    cut = best.join(F.broadcast(whole), list(by))
    above = cut.where(F.col("_seen") <= F.col("_k")).groupBy(*by).agg(F.sum("p").alias("_above"))
    edge = cut.where((F.col("_seen") > F.col("_k")) & (F.col("_seen") - F.col("n") < F.col("_k"))).select(
        *by, "score", (F.col("_k") - (F.col("_seen") - F.col("n"))).alias("_need")
    )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("sample_id"))
    tied = scored.join(edge, [*by, "score"]).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_need")).groupBy(*by).agg(F.sum("label").alias("_edge"))
    found = F.coalesce("_above", F.lit(0)) + F.coalesce("_edge", F.lit(0))
    return whole.join(above, list(by), "left").join(tied, list(by), "left").select(
        *by, F.round(ratio(found, F.col("_all")), 6).alias("recall_at_k"), F.round(ratio(found, F.col("_k")), 6).alias("precision_at_k")
    )


def evaluate(scored: DataFrame, threshold: float = 0.5, fraction: float = 0.1, by: Sequence[str] = ("split",)) -> DataFrame:
    """Sample counts and all metrics per group."""
    counts = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_count"), F.sum("label").alias("positive_count"), _f1(threshold))
    areas = _per_score(scored, by).groupBy(*by).agg(_pr_auc(), _roc_auc())
    best = top_k_metrics(scored, fraction, by)
    joined = counts.join(areas, list(by), "left").join(best, list(by), "left")
    return joined.select(*by, "sample_count", "positive_count", "pr_auc", "roc_auc", "f1", "recall_at_k", "precision_at_k")
