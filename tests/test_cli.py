"""The steps from a CSV file to model metrics."""

import pytest

from clickloom.__main__ import main
from clickloom.operators import comparison
from clickloom.sources import artifacts
from clickloom.sources.clickstream import clickstream
from pyspark.sql import functions as F


def test_steps(spark, tmp_path):
    events = clickstream(spark, "/root/testdata/sf0.001").withColumn("event_time", F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
    events.drop("source_order").coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    for step in ("labels", "features"):
        main([step, "--events", str(tmp_path / "in"), "--out", str(tmp_path / step), "--window-minutes", "360", "--until", "2024-01-25"], spark)
    main(["baselines", "--features", str(tmp_path / "features"), "--out", str(tmp_path / "models"), "--models", "logistic_regression"], spark)
    metrics = spark.read.option("header", True).csv(str(tmp_path / "models/model_metrics"))
    assert metrics.count() == 6 and comparison.best_strategy(metrics).count() == 1
    artifacts.write_comparison(metrics, metrics.limit(0), str(tmp_path / "final"))
    assert spark.read.option("header", True).csv(str(tmp_path / "final/final_comparison")).count() == 3
    assert artifacts.read_samples(spark, str(tmp_path / "features"), sequences=True, per_split=5).count() == 15
    main(["report", "--baselines", str(tmp_path / "models"), "--out", str(tmp_path / "page")], spark)
    page = artifacts.read_text(spark, str(tmp_path / "page/interpretation.md"))
    assert "Best on the test split: Logistic Regression" in page and "No importance is known." in page
    assert artifacts.read_report(spark, str(tmp_path / "page/final_comparison")).select("source_artifact", "threshold").distinct().collect() == [("model_metrics", "0.5")]
    main(["sequences", "--features", str(tmp_path / "features"), "--out", str(tmp_path / "encoded")], spark)
    encoded = spark.read.parquet(str(tmp_path / "encoded/encoded_sequences"))
    assert encoded.count() == spark.read.parquet(str(tmp_path / "features/sample_index")).count() and encoded.select(F.size("product_id_ids")).distinct().first()[0] == 50


def test_report_needs_its_tables(spark, tmp_path):
    assert artifacts.read_report(spark, str(tmp_path / "none")) is None and artifacts.read_text(spark, str(tmp_path / "none")) is None
    status = artifacts.artifact_status(spark, {name: str(tmp_path / name) for name in artifacts.WRITTEN_BY})
    assert artifacts.missing_commands(status) == ["python -m clickloom baselines", "python -m clickloom report"]
    with pytest.raises(SystemExit):
        main(["report", "--baselines", str(tmp_path), "--out", str(tmp_path / "out")], spark)


def test_interpretation_of_both_kinds(spark, tmp_path):
    kind = "model_name string, class_imbalance_strategy string, split string, sample_count long, positive_count long, pr_auc double, status string"
    rows = [(m, "none", s, 10, 2, v, "evaluated") for m, v in (("gbt", 0.5), ("gru", 0.25)) for s in ("validation", "test")]
    rows += [("odd", "none", "test", 9, 2, None, "evaluated")]
    table = spark.createDataFrame(rows, kind)
    ranks = spark.createDataFrame([("gbt", "none", "hour", 0.1, "gain", 2), ("gbt", "none", "last_event_type=cart", 0.9, "gain", 1)],
                                  "model_name string, class_imbalance_strategy string, feature_name string, importance double, importance_type string, rank int")
    final = comparison.final_comparison(table.where("model_name <> 'gru'"), table.where("model_name = 'gru'"))
    assert final.where("split = 'test'").select("model_name", "sample_contract_status").distinct().count() == 3
    page = comparison.interpretation(final, ranks).split("\n")
    assert "- The sequence model's PR-AUC is 0.250000 below the best baseline's." in page
    assert [line.split("`")[1] for line in page if line.startswith("- `")] == ["last_event_type=cart", "hour"]
    assert comparison.selected_strategy(final, "gbt") == "none" and comparison.selected_strategy(final, "absent") is None
    history = spark.createDataFrame([(1, 0.9, 0.2), (2, 0.7, 0.25)], "epoch int, train_loss double, validation_pr_auc double")
    artifacts.write_sequence_model(table.where("model_name = 'gru'"), history, str(tmp_path / "sequence"))
    assert artifacts.read_report(spark, str(tmp_path / "sequence/training_trend")).first().best_epoch == "2"
