"""Command line: python -m clickloom STEP --events FILE.csv --out FOLDER."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from clickloom.operators import models
from clickloom.policies import BaselinePolicy, FeaturePolicy, LabelingPolicy, QualityPolicy, SequencePolicy
from clickloom.sources import artifacts
from clickloom.sources.clickstream import first_rows, read_csv, renumbered, until


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run one step; its artifacts go to the output folder."""
    parser = argparse.ArgumentParser(prog="clickloom", description=__doc__)
    parser.add_argument("step", choices=("profile", "quality", "labels", "eda", "features", "baselines", "sequences", "report"))
    parser.add_argument("--events", help="clickstream CSV (profile to features)")
    parser.add_argument("--features", help="feature folder (baselines, sequences)")
    parser.add_argument("--baselines", help="folder of the baselines step (report)")
    parser.add_argument("--sequence-metrics", help="metric CSV of a sequence model (report); without it only baselines are compared")
    parser.add_argument("--out", required=True)
    parser.add_argument("--window-minutes", type=int, default=30)
    parser.add_argument("--until", help="last time, or last day")
    parser.add_argument("--max-rows", type=int)
    parser.add_argument("--long-session", type=int, default=100)
    parser.add_argument("--max-sequence-length", type=int, default=50)
    parser.add_argument("--max-samples-per-split", type=int)
    parser.add_argument("--train-ratio", type=float, default=0.70)
    parser.add_argument("--validation-ratio", type=float, default=0.15)
    parser.add_argument("--models", nargs="+", default=["logistic_regression", "gbt"], choices=["logistic_regression", "gbt", "leafwise"])
    parser.add_argument("--trees", type=int, default=200)
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("clickloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.step == "report":
        if not given.baselines:
            parser.error("report needs --baselines")
        names = ("model_metrics", "feature_importance")
        paths = {name: f"{given.baselines}/{name}" for name in names}
        metrics, importance = (artifacts.read_report(spark, paths[name]) for name in names)
        if metrics is None or importance is None:
            parser.error("first run: " + ", ".join(artifacts.missing_commands(artifacts.artifact_status(spark, paths))))
        sequence = artifacts.read_report(spark, given.sequence_metrics) if given.sequence_metrics else metrics.limit(0)
        if sequence is None:
            parser.error(f"no metrics at {given.sequence_metrics}")
        artifacts.write_comparison(metrics, sequence, given.out, importance)
        return
    if given.step in ("baselines", "sequences") and not given.features:
        parser.error(f"{given.step} needs --features")
    if given.step == "sequences":
        samples = artifacts.read_samples(spark, given.features, sequences=True, per_split=given.max_samples_per_split)
        artifacts.write_sequences(samples, given.out, SequencePolicy(max_sequence_length=given.max_sequence_length))
        return
    if given.step == "baselines":
        samples = artifacts.read_samples(spark, given.features, per_split=given.max_samples_per_split)
        artifacts.write_baselines(*models.train_baselines(samples, BaselinePolicy(trees=given.trees), tuple(given.models), print), given.out)
        return
    if not given.events:
        parser.error(f"{given.step} needs --events")
    events = renumbered(first_rows(until(read_csv(spark, given.events), given.until), given.max_rows))
    if given.step == "profile":
        artifacts.write_profile(events, given.out)
    elif given.step == "quality":
        artifacts.write_quality(events, given.out, QualityPolicy(given.long_session))
    elif given.step == "labels":
        artifacts.write_labels(events, given.out, LabelingPolicy(given.window_minutes))
    elif given.step == "eda":
        artifacts.write_eda(events, given.out, given.window_minutes)
    else:
        artifacts.write_features(events, given.out, FeaturePolicy(given.window_minutes, given.train_ratio, given.validation_ratio, given.max_sequence_length))


if __name__ == "__main__":
    main()
