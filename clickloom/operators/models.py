"""Baseline classifiers on the tabular features. Fitting runs actions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.boosting import LeafwisePolicy, fit_leafwise
from clickloom.operators.features import CATEGORICAL_INPUTS, NUMERIC_INPUTS
from clickloom.operators.metrics import evaluate
from clickloom.policies import MISSING, SPLITS, BaselinePolicy


def exact_medians(rows: DataFrame, columns: Sequence[str], margin: float = 5e-4) -> dict[str, float | None]:
    """The median of each column without its nulls, None if it holds nothing else; no buffer holds a column.

    Approximate quantiles on both sides of the middle bracket the median. Values below are counted,
    and only those in the bracket are counted one by one. A bracket that misses is widened.
    """
    found: dict[str, float | None] = {}
    values = {c: F.col(c).cast("double") for c in columns}
    while left := [c for c in columns if c not in found]:
        shares = [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)]
        brackets = rows.agg(*[F.percentile_approx(values[c], shares, 10_000).alias(c) for c in left]).first()
        found |= {c: None for c in left if brackets[c] is None}
        left = [c for c in left if brackets[c] is not None]
        if not left:
            break
        sides = rows.agg(*[f(values[c]).alias(f"{k}{c}") for c in left for k, f in (("n", F.count), ("b", lambda x, low=brackets[c][0]: F.count_if(x < low)))]).first()
        inside = F.array(*[F.struct(F.lit(c).alias("c"), F.when(values[c].between(*brackets[c]), values[c]).alias("x")) for c in left])
        counts = rows.select(F.inline(inside)).where("x is not null").groupBy("c", "x").count().collect()
        for c in left:
            below, middle, at = sides[f"b{c}"], (sides[f"n{c}"] - 1) / 2, []
            for _, x, n in sorted((math.isnan(r.x), r.x, r["count"]) for r in counts if r.c == c):
                at += [x for rank in (math.floor(middle), math.ceil(middle)) if below <= rank < below + n]
                below += n
            if len(at) == 2:
                found[c] = at[0] if at[0] == at[1] else 0.5 * at[0] + 0.5 * at[1]
        margin = max(4 * margin, 1e-4)
    return found


@dataclass(frozen=True)
class Preprocessor:
    """Medians, means and deviations of numbers, and categories, of the training samples."""

    numeric: dict[str, tuple[float, float, float]]
    categories: dict[str, list[str]]

    @classmethod
    def fit(cls, samples: DataFrame) -> Preprocessor:
        """Exact medians fill nulls; mean and population deviation are those of the filled column. Reads the samples a few times."""
        train = samples.where(F.col("split") == "train")
        medians = exact_medians(train, NUMERIC_INPUTS)
        fill = {c: (medians[c] if medians[c] is not None else 0.0) for c in NUMERIC_INPUTS}
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in NUMERIC_INPUTS}
        stats = [f(x).alias(f"{k}_{c}") for c, x in filled.items() for k, f in (("m", F.avg), ("s", F.stddev_pop))]
        sets = [F.array_sort(F.collect_set(F.coalesce(F.col(c), F.lit(MISSING)))).alias(c) for c in CATEGORICAL_INPUTS]
        row = train.agg(*stats, *sets).first()
        return cls(
            {c: (fill[c], row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in NUMERIC_INPUTS}, {c: list(row[c]) for c in CATEGORICAL_INPUTS}
        )

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *(f"{c}={v}" for c, values in self.categories.items() for v in values)]

    def vector(self) -> Column:
        """Standardized numbers, then a 0/1 column per category; unseen categories are all 0."""
        numbers = [(F.coalesce(F.col(c).cast("double"), F.lit(fill)) - mean) / (std or 1.0) for c, (fill, mean, std) in self.numeric.items()]
        flags = [F.when(F.coalesce(F.col(c), F.lit(MISSING)) == v, 1.0).otherwise(0.0) for c, values in self.categories.items() for v in values]
        return array_to_vector(F.array(*numbers, *flags))


def weighted(train: DataFrame, strategy: str) -> tuple[DataFrame, float, int]:
    """Training samples with their class weight, the sum of weights, and the number of classes."""
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    if strategy == "balanced" and len(counts) == 2:
        weight = F.when(F.col("label") == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
    elif strategy not in ("none", "balanced"):
        raise ValueError(f"unknown strategy {strategy}")
    return train.withColumn("_weight", weight), float(total), len(counts)


def fit_logistic(train: DataFrame, total: float, policy: BaselinePolicy):
    """L2 logistic regression; the penalty is that of a sum of losses with inverse strength C."""
    return LogisticRegression(
        featuresCol="_x", labelCol="label", weightCol="_weight", maxIter=policy.max_iter, elasticNetParam=0.0,
        regParam=1.0 / (policy.inverse_regularization * total), standardization=False,
    ).fit(train)


def fit_trees(train: DataFrame, policy: BaselinePolicy):
    """Gradient-boosted trees."""
    return GBTClassifier(
        featuresCol="_x", labelCol="label", weightCol="_weight", maxIter=policy.trees, stepSize=policy.learning_rate, maxDepth=policy.tree_depth,
        subsamplingRate=policy.subsample, featureSubsetStrategy=str(policy.column_share), seed=policy.seed,
    ).fit(train)


def fit_leaves(train: DataFrame, strategy: str, policy: BaselinePolicy):
    """Trees grown leaf by leaf; `balanced` weighs positives by the ratio of negatives to them."""
    settings = LeafwisePolicy(trees=policy.trees, learning_rate=policy.learning_rate, subsample=policy.subsample, column_share=policy.column_share, seed=policy.seed)
    return fit_leafwise(train.select("sample_id", "label", vector_to_array("_x").alias("x")), strategy == "balanced", settings)


def scored(model, samples: DataFrame) -> DataFrame:
    """sample_id, split, label, score."""
    if hasattr(model, "split_counts"):
        return samples.select("sample_id", "split", "label", model.score(vector_to_array("_x")).alias("score"))
    return model.transform(samples).select("sample_id", "split", "label", vector_to_array("probability")[1].alias("score"))


def train_baselines(
    samples: DataFrame, policy: BaselinePolicy = BaselinePolicy(), models: tuple[str, ...] = ("logistic_regression", "gbt"), progress: Callable[[str], None] = lambda _: None
) -> tuple[DataFrame, DataFrame]:
    """Metrics per model, strategy and split, and ranked feature importance.

    Models are logistic_regression, gbt (Spark's level-wise trees) and leafwise.
    A training split of one class is skipped with a status row. Metrics have the columns of
    comparison.COLUMNS.
    """
    spark = samples.sparkSession
    rows = samples.select("sample_id", "split", F.col("label").cast("int").alias("label"), *NUMERIC_INPUTS, *CATEGORICAL_INPUTS).persist()
    fitted = Preprocessor.fit(rows)
    ready = rows.select("sample_id", "split", "label", fitted.vector().alias("_x"))
    scores, skipped, importance = [], [], []
    for name in models:
        for strategy in policy.strategies:
            progress(f"{name} / {strategy}")
            train, total, classes = weighted(ready.where(F.col("split") == "train"), strategy)
            if classes < 2:
                skipped += [(name, strategy, s) for s in SPLITS]
                continue
            if name == "logistic_regression":
                model = fit_logistic(train, total, policy)
                values, kind = model.coefficients.toArray(), "coefficient"
            elif name == "leafwise":
                model = fit_leaves(train, strategy, policy)
                values, kind = model.split_counts, "split_count"
            else:
                model = fit_trees(train, policy)
                values, kind = model.featureImportances.toArray(), "gain"
            scores.append(scored(model, ready).withColumns({"model_name": F.lit(name), "class_imbalance_strategy": F.lit(strategy)}))
            ranked = sorted(zip(fitted.names, map(float, values)), key=lambda x: -abs(x[1]))
            importance += [(name, strategy, f, v, kind, i + 1) for i, (f, v) in enumerate(ranked)]
    by = ("model_name", "class_imbalance_strategy", "split")
    none = spark.createDataFrame(skipped, "model_name string, class_imbalance_strategy string, split string").withColumn("status", F.lit("skipped_single_class"))
    table = none
    if scores:  # all of them in one plan: a union of evaluations would put the operators of each into the same tasks
        every = reduce(DataFrame.unionByName, scores).persist()  # metrics read the scores a dozen times
        table = evaluate(every, policy.threshold, policy.top_k_fraction, by).withColumn("status", F.lit("evaluated"))
        if skipped:
            table = table.unionByName(none, allowMissingColumns=True)
    table = table.withColumns({"threshold": F.lit(policy.threshold), "top_k_fraction": F.lit(policy.top_k_fraction)})
    kinds = {"sample_count": "long", "positive_count": "long"} | dict.fromkeys(("pr_auc", "roc_auc", "f1", "recall_at_k", "precision_at_k"), "double")
    absent = {c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in table.columns}
    table = table.withColumns(absent).select("split", *kinds, "model_name", "class_imbalance_strategy", "threshold", "top_k_fraction", "status")
    schema = "model_name string, class_imbalance_strategy string, feature_name string, importance double, importance_type string, rank int"
    return table, spark.createDataFrame(importance, schema)
