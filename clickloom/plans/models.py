"""Metric, comparison and model queries. Scores are a fixed expression of the features, so SQL can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import comparison, metrics, models
from clickloom.plans.features import _F, _built
from clickloom.policies import BaselinePolicy

_POLICY = BaselinePolicy(strategies=("none", "balanced"), trees=10)

_SHIFTS = (("logistic_regression", "none", 0), ("logistic_regression", "balanced", 7), ("gbt", "none", 13), ("gbt", "balanced", 29))


def _scored(spark, sf_dir):
    score = ((F.col("event_count_cart") * 37 + F.col("prefix_length") * 11 + F.col("hour")) % 101) / 100.0
    return _built(spark, sf_dir).select("sample_id", "split", "label", score.alias("score"))


def _metrics(spark, sf_dir):
    """Evaluated rows of two models with two strategies, as a metrics table: all of them in one plan."""
    kinds = F.array(*[F.struct(F.lit(m).alias("model_name"), F.lit(s).alias("class_imbalance_strategy"), F.lit(n).alias("shift")) for m, s, n in _SHIFTS])
    every = _scored(spark, sf_dir).select("*", F.inline(kinds)).withColumn("score", F.round((F.col("score") * 100 + F.col("shift")) % 101) / 100.0)
    return metrics.evaluate(every, by=("model_name", "class_imbalance_strategy", "split")).withColumns({"threshold": F.lit(0.5), "top_k_fraction": F.lit(0.1), "status": F.lit("evaluated")})


def _final(spark, sf_dir):
    rows = _metrics(spark, sf_dir)
    return comparison.final_comparison(rows.where("model_name = 'logistic_regression'"), rows.where("model_name = 'gbt'"))


def _importance(spark, sf_dir):
    found = models.train_baselines(_built(spark, sf_dir), BaselinePolicy(strategies=("none",), trees=5), ("logistic_regression",))[1]
    return comparison.top_importance(found)


QUERIES = {
    "average_precision": lambda spark, d: metrics.average_precision(_scored(spark, d)),
    "roc_auc": lambda spark, d: metrics.roc_auc(_scored(spark, d)),
    "f1_at_threshold": lambda spark, d: metrics.f1_at_threshold(_scored(spark, d)),
    "recall_precision_at_k": lambda spark, d: metrics.top_k_metrics(_scored(spark, d)),
    "evaluate": lambda spark, d: metrics.evaluate(_scored(spark, d)),
    "best_strategy": lambda spark, d: comparison.best_strategy(_metrics(spark, d)),
    "sample_contract_status": lambda spark, d: comparison.sample_contract_status(_metrics(spark, d)),
    "final_comparison": _final,
    "test_metrics": lambda spark, d: comparison.test_metrics(_metrics(spark, d)),
    "status_counts": lambda spark, d: comparison.status_counts(_metrics(spark, d)),
    "logistic_baseline": lambda spark, d: models.train_baselines(_built(spark, d), _POLICY, ("logistic_regression",))[0],
    "gbt_baseline": lambda spark, d: models.train_baselines(_built(spark, d), BaselinePolicy(strategies=("none",), trees=5), ("gbt",))[0],
    "leafwise_boosting": lambda spark, d: models.train_baselines(_built(spark, d), BaselinePolicy(strategies=("none",), trees=5), ("leafwise",))[0],
    "feature_importance": _importance,
}

_SCORED = f"{_F}, sc AS (SELECT sample_id, split, label, ((event_count_cart * 37 + prefix_length * 11 + hour) % 101) / 100.0::DOUBLE AS score FROM f)"


def _evaluated(source: str, name: str) -> str:
    """CTEs that end in `name` with all metrics per split."""
    return f"""{name}_c AS (SELECT split, score, count(*) AS n, sum(label) AS p FROM {source} GROUP BY 1, 2), {name}_r AS (
      SELECT *, sum(n) OVER (PARTITION BY split ORDER BY score DESC) AS seen, sum(p) OVER (PARTITION BY split ORDER BY score DESC) AS hits,
             sum(n - p) OVER (PARTITION BY split ORDER BY score) - (n - p) AS below FROM {name}_c
    ), {name}_k AS (SELECT split, label, row_number() OVER (PARTITION BY split ORDER BY score DESC, sample_id) AS i, greatest(1, ceil(count(*) OVER (PARTITION BY split) * 0.1::DOUBLE)) AS k FROM {source}),
    {name}_t AS (SELECT split, sum(label)::DOUBLE AS found, max(k) AS k FROM {name}_k WHERE i <= k GROUP BY 1),
    {name}_a AS (SELECT split, round(sum(p::DOUBLE * hits / seen) / sum(p), 6) AS pr_auc, round(sum(p * (below + (n - p) / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n - p)), 6) AS roc_auc FROM {name}_r GROUP BY 1),
    {name}_b AS (SELECT split, count(*) AS sample_count, sum(label)::BIGINT AS positive_count,
        round(coalesce(2.0::DOUBLE * count(*) FILTER (score >= 0.5 AND label = 1) / nullif(count(*) FILTER (score >= 0.5) + sum(label), 0), 0), 6) AS f1 FROM {source} GROUP BY 1),
    {name} AS (SELECT split, sample_count, positive_count, pr_auc, roc_auc, f1, round(coalesce(found / nullif(positive_count, 0), 0), 6) AS recall_at_k, round(found / k, 6) AS precision_at_k
      FROM {name}_b JOIN {name}_a USING (split) JOIN {name}_t USING (split))"""


_TABLE = _SCORED + "".join(
    f", s{i} AS (SELECT sample_id, split, label, round((score * 100 + {shift}) % 101) / 100.0::DOUBLE AS score FROM sc), {_evaluated(f's{i}', f'e{i}')}" for i, (_, _, shift) in enumerate(_SHIFTS)
) + ", mt AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model_name, '{s}' AS class_imbalance_strategy, *, 0.5::DOUBLE AS threshold, 0.1::DOUBLE AS top_k_fraction, 'evaluated' AS status FROM e{i}" for i, (m, s, _) in enumerate(_SHIFTS)) + ")"
_BEST = "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY pr_auc DESC, class_imbalance_strategy) AS i FROM mt WHERE split = 'validation' AND pr_auc IS NOT NULL) WHERE i = 1)"
_ONE = f"{_SCORED}, {_evaluated('sc', 'ev')}"

ORACLE_SQL = {
    "average_precision": f"{_ONE} SELECT split, pr_auc FROM ev",
    "roc_auc": f"{_ONE} SELECT split, roc_auc FROM ev",
    "f1_at_threshold": f"{_ONE} SELECT split, f1 FROM ev",
    "recall_precision_at_k": f"{_ONE} SELECT split, recall_at_k, precision_at_k FROM ev",
    "evaluate": f"{_ONE} SELECT * FROM ev",
    "best_strategy": f"{_TABLE}, {_BEST} SELECT model_name, class_imbalance_strategy, split AS selected_on, pr_auc AS selected_value FROM bs",
    "sample_contract_status": f"{_TABLE} SELECT split, CASE WHEN count(DISTINCT model_name) <= 1 THEN 'single_model_only' WHEN count(DISTINCT (sample_count, positive_count)) = 1 THEN 'matched_by_split_counts' ELSE 'mismatch_by_split_counts' END AS sample_contract_status FROM mt GROUP BY 1",
    "final_comparison": f"""{_TABLE}, {_BEST}, ch AS (SELECT mt.* FROM mt JOIN bs USING (model_name, class_imbalance_strategy)),
      cs AS (SELECT split, CASE WHEN count(DISTINCT model_name) <= 1 THEN 'single_model_only' WHEN count(DISTINCT (sample_count, positive_count)) = 1
             THEN 'matched_by_split_counts' ELSE 'mismatch_by_split_counts' END AS sample_contract_status FROM ch GROUP BY 1)
      SELECT CASE model_name WHEN 'gbt' THEN 'Gradient-boosted trees' ELSE 'Logistic Regression' END || ' (' || class_imbalance_strategy || ')' AS model_display, ch.*,
             'validation_pr_auc' AS selection_metric, sample_contract_status,
             CASE model_name WHEN 'gbt' THEN 'sequence_metrics' ELSE 'model_metrics' END AS source_artifact FROM ch JOIN cs USING (split)""",
    "test_metrics": f"{_TABLE} SELECT * FROM mt WHERE split = 'test'",
    "status_counts": f"{_TABLE} SELECT status, count(*) AS count FROM mt GROUP BY 1",
}
