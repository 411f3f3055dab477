"""Artifact writers: columnar tables, small report tables, and markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import eda, features, labels, profile, quality
from clickloom.policies import FeaturePolicy, LabelingPolicy, QualityPolicy, SequencePolicy


def write_parquet(df: DataFrame, path: str) -> None:
    """A large table; an earlier one at the path is replaced when this one is complete."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """A small table as markdown."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |" for row in rows])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Text as a single-part text folder."""
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_reports(spark: SparkSession, tables: dict[str, DataFrame], title: str, folder: str) -> None:
    """Every table as CSV, and one markdown page of all."""
    parts = [f"# {title}"]
    for name, table in tables.items():
        write_report(table, f"{folder}/{name}")
        parts += [f"\n## {name}\n", markdown_table(table)]
    write_text(spark, "\n".join(parts), f"{folder}/{title.lower().replace(' ', '_')}.md")


def write_profile(events: DataFrame, folder: str) -> None:
    """Profile, distributions, missing values, draft issues and preview."""
    tables = {
        "profile_summary": profile.profile_summary(events),
        "event_type_distribution": profile.event_type_distribution(events),
        "missing_values": profile.missing_values(events),
        "quality_issue_draft": profile.quality_issues(events),
        "raw_preview": profile.raw_preview(events),
    }
    write_reports(events.sparkSession, tables, "Data profile", folder)


def write_quality(events: DataFrame, folder: str, policy: QualityPolicy = QualityPolicy()) -> None:
    """Quality checks, session comparison and long sessions."""
    tables = {
        "quality_summary": quality.quality_summary(events, policy),
        "missing_values": profile.missing_values(events),
        "session_comparison": quality.session_comparison(events),
        "extreme_sessions": quality.extreme_sessions(events, policy),
    }
    write_reports(events.sparkSession, tables, "Data quality", folder)


def write_labels(events: DataFrame, folder: str, policy: LabelingPolicy = LabelingPolicy()) -> None:
    """Label distribution and rules."""
    tables = {"label_distribution": labels.label_distribution(events, policy), "label_policy": labels.label_policy(events.sparkSession, policy)}
    write_reports(events.sparkSession, tables, "Labels", folder)


def write_eda(events: DataFrame, folder: str, minutes: int = 30) -> None:
    """The seven exploratory tables."""
    tables = {
        "eda_overview": eda.eda_overview(events, minutes),
        "conversion_by_session_length": eda.conversion_by_session_length(events),
        "conversion_by_pattern": eda.conversion_by_pattern(events),
        "conversion_by_price_band": eda.conversion_by_price_band(events, minutes),
        "conversion_by_hour": eda.conversion_by_hour(events, minutes),
        "category_conversion": eda.category_conversion(events),
        "sample_comparison": eda.sample_comparison(events, minutes),
    }
    write_reports(events.sparkSession, tables, "Exploratory analysis", folder)


def write_features(events: DataFrame, folder: str, policy: FeaturePolicy = FeaturePolicy()) -> None:
    """Sample index, tabular and sequence tables and their reports.

    The samples are written once and the projections and reports read that table.
    """
    spark = events.sparkSession
    write_parquet(features.build_features(events, policy), f"{folder}/samples")
    samples = spark.read.parquet(f"{folder}/samples")
    write_parquet(features.sample_index(samples), f"{folder}/sample_index")
    write_parquet(features.tabular_features(samples), f"{folder}/tabular_features")
    write_parquet(features.sequence_features(samples), f"{folder}/sequence_features")
    tables = {
        "split_summary": features.split_summary(samples),
        "transformer_scope": features.transformer_scope(samples),
        "feature_dictionary": features.feature_dictionary(spark),
        "leakage_checks": features.leakage_checks(samples),
    }
    write_reports(spark, tables, "Features", f"{folder}/reports")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found))


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A table written by write_report, or any CSV file with header, as text columns; None if it isn't there."""
    return spark.read.option("header", True).csv(path) if _exists(spark, path) else None


def read_text(spark: SparkSession, path: str) -> str | None:
    """A page written by write_text; None if it isn't there."""
    if not _exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.text(path).coalesce(1).collect())


#: The step that writes each artifact which the final report shows.
WRITTEN_BY = {
    "model_metrics": "baselines", "feature_importance": "baselines", "model_status": "baselines",
    "final_comparison": "report", "interpretation.md": "report",
}


def artifact_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, path, present, and the command that writes it (null if unknown) of expected artifacts, on any file system."""
    rows = []
    for name, path in paths.items():
        step = WRITTEN_BY.get(name)
        rows.append((name, path, _exists(spark, path), step and f"python -m clickloom {step}"))
    return spark.createDataFrame(rows, "name string, path string, present boolean, command string").orderBy(F.col("present"), "name")


def missing_commands(status: DataFrame) -> list[str]:
    """The commands that write what is absent, each once, in their order in WRITTEN_BY."""
    wanted = {r.command for r in status.where("not present and command is not null").select("command").distinct().collect()}
    return [c for c in dict.fromkeys(f"python -m clickloom {step}" for step in WRITTEN_BY.values()) if c in wanted]


def read_samples(spark: SparkSession, folder: str, sequences: bool = False, per_split: int | None = None) -> DataFrame:
    """Sample index joined one to one with the tabular or the sequence inputs of a feature folder.

    With per_split the index is cut first, to a stratified sample for tabular inputs and to the
    first samples for sequences, and the inputs are semi-joined to it.
    """
    from clickloom.operators import sequences as seq

    index = spark.read.parquet(f"{folder}/sample_index")
    inputs = spark.read.parquet(f"{folder}/{'sequence_features' if sequences else 'tabular_features'}")
    if per_split is not None:
        index = seq.head_per_split(index, per_split) if sequences else seq.stratified_cap(index, per_split)
        inputs = inputs.join(index.select("sample_id"), "sample_id", "left_semi")
    return seq.join_samples(index, inputs)


def write_baselines(metrics: DataFrame, importance: DataFrame, folder: str) -> None:
    """Model metrics, feature importance and status counts."""
    from clickloom.operators import comparison

    tables = {"model_metrics": metrics, "feature_importance": importance, "model_status": comparison.status_counts(metrics)}
    write_reports(metrics.sparkSession, tables, "Baseline models", folder)


def write_sequences(samples: DataFrame, folder: str, policy: SequencePolicy = SequencePolicy()) -> None:
    """The encoded data set of a sequence model: vocabulary, gap scaler, and encoded samples by split.

    `samples` has split, label and the sequences (read_samples with sequences). The vocabulary is
    stored first, so it isn't counted again for the encoding.
    """
    from clickloom.operators import sequences as seq

    spark = samples.sparkSession
    write_parquet(seq.token_vocabulary(samples, policy), f"{folder}/token_vocabulary")
    vocabulary = spark.read.parquet(f"{folder}/token_vocabulary")
    write_report(seq.time_gap_scaler(samples, policy), f"{folder}/time_gap_scaler")
    seq.encoded_sequences(samples, vocabulary, policy).write.mode("overwrite").partitionBy("split").parquet(f"{folder}/encoded_sequences")


def write_sequence_model(metrics: DataFrame, history: DataFrame, folder: str) -> None:
    """Metrics, status and training history of a sequence model that was fitted elsewhere on the encoded data set."""
    from clickloom.operators import comparison

    tables = {
        "sequence_metrics": metrics,
        "sequence_status": comparison.status_counts(metrics),
        "training_history": history.orderBy("epoch"),
        "training_trend": comparison.training_trend(history),
    }
    write_reports(metrics.sparkSession, tables, "Sequence model", folder)


def write_comparison(baseline: DataFrame, sequence: DataFrame, folder: str, importance: DataFrame | None = None) -> None:
    """The final comparison of baseline and sequence models, the test metrics of both and, with importance, its interpretation."""
    from clickloom.operators import comparison

    compared = comparison.final_comparison(baseline, sequence)
    both = comparison.normalized(baseline).unionByName(comparison.normalized(sequence))
    write_reports(baseline.sparkSession, {"final_comparison": compared, "test_metrics": comparison.test_metrics(both)}, "Model comparison", folder)
    if importance is not None:
        write_text(baseline.sparkSession, comparison.interpretation(compared, importance), f"{folder}/interpretation.md")
