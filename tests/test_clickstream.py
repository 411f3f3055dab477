"""Hand-made cases of the clickstream operators."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.functions import scalars as s
from clickloom.operators import comparison, eda, features, labels, metrics, models, profile, quality, sequences
from clickloom.policies import BaselinePolicy, FeaturePolicy, LabelingPolicy, QualityPolicy, SequencePolicy
from clickloom.sources import artifacts, clickstream

RAW = "source_order long, event_time string, event_type string, product_id string, category_id string, category_code string, brand string, price string, user_id string, user_session string"


def raw(spark, rows):
    """Rows of (minute or text, type, session[, price[, product[, user]]])."""
    out = []
    for i, (at, kind, session, *more) in enumerate(rows):
        price, product, user = (*more, *("10.0", "1", "1")[len(more) :])
        time = at if isinstance(at, (str, type(None))) else (dt.datetime(2019, 10, 1) + dt.timedelta(minutes=at)).strftime("%Y-%m-%d %H:%M:%S UTC")
        out.append((i, time, kind, product, "7", "electronics.phone", None, price, user, session))
    return spark.createDataFrame(out, RAW)


def events(spark, rows):
    return clickstream.canonical(raw(spark, rows))


def as_dict(df, key):
    return {r[key]: r for r in df.collect()}


def test_scalars(spark):
    df = spark.createDataFrame([(None, None), (25.0, "a.b"), (25.01, ""), (1000.0, "nan"), (1000.5, ".x")], "p double, c string")
    found = df.select(s.price_band(F.col("p")).alias("b"), s.top_level_category(F.col("c")).alias("c")).collect()
    assert [r.b for r in found] == ["<missing>", "(-inf, 25]", "(25, 50]", "(500, 1000]", "(1000, inf)"]
    assert [r.c for r in found] == ["<missing>", "a", "<missing>", "<missing>", "<missing>"]
    t = spark.createDataFrame([("2019-10-01 00:00:00 UTC",), ("2019-10-01 00:00:00",), ("bad-time",), (None,), ("2019-13-01 00:00:00 UTC",)], "t string")
    assert [r[0] is not None for r in t.select(s.parse_event_time(F.col("t"))).collect()] == [True, False, False, False, False]
    n = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,), ("-2",)], "n string")
    assert [r[0] for r in n.select(s.parse_number(F.col("n"))).collect()] == [1.5, None, None, None, -2.0]
    assert [r[0] for r in n.select(s.non_negative(F.col("n"))).collect()] == [1.5, 0.0, 0.0, 0.0, 0.0]
    a = spark.createDataFrame([("a  b c",), (None,), ("",)], "x string").select(s.split_sequence(F.col("x")).alias("x"))
    assert [r[0] for r in a.select(s.tail(F.col("x"), 2)).collect()] == [["b", "c"], [], []]
    assert a.select(s.padded(F.col("x"), 4, F.lit("-"))).first()[0] == ["a", "b", "c", "-"]


def test_labels_look_ahead_only_inside_window_and_session(spark):
    rows = [(0, "view", "a"), (1, "cart", "a"), (20, "purchase", "a"), (21, "view", "a"), (0, "view", "b"), (31, "purchase", "b"), (0, "view", "c")]
    found = labels.prefix_labels(events(spark, rows)).orderBy("user_session", "session_position").collect()
    assert [(r.user_session, r.label, r.prefix_event_types) for r in found] == [("a", 1, "view"), ("a", 1, "view cart"), ("b", 0, "view"), ("c", 0, "view")]
    assert found[0].minutes_until_purchase == 20 and found[0].cutoff_time == "2019-10-01T00:00:00+00:00"
    current = labels.prefix_labels(events(spark, rows), LabelingPolicy(include_current_event_in_prefix=False)).orderBy("user_session", "session_position").collect()
    assert [(r.prefix_length, r.prefix_event_types) for r in current[:2]] == [(0, ""), (1, "view")]
    every = labels.prefix_labels(events(spark, rows), LabelingPolicy(exclude_at_or_after_first_purchase=False))
    assert every.count() == 7


def test_purchase_at_the_cutoff_is_not_in_the_future(spark):
    rows = [(0, "view", "a"), (0, "purchase", "a"), (10, "view", "a"), (15, "purchase", "a")]
    assert labels.prefix_labels(events(spark, rows)).count() == 0
    every = labels.prefix_labels(events(spark, rows), LabelingPolicy(exclude_at_or_after_first_purchase=False)).orderBy("session_position").collect()
    assert [r.label for r in every] == [1, 1, 1, 0]


def test_label_distribution_counts_exclusions(spark):
    rows = [(0, "view", "a"), (5, "purchase", "a"), (6, "view", "a"), ("bad-time", "view", "a"), (0, "view", None)]
    r = labels.label_distribution(events(spark, rows)).first()
    assert (r.candidate_event_count, r.labeled_sample_count, r.positive_count) == (5, 1, 1)
    assert (r.excluded_missing_session_count, r.excluded_invalid_time_count, r.excluded_at_or_after_first_purchase_count) == (1, 1, 2)
    assert (r.session_count, r.purchase_session_count, r.positive_ratio) == (1, 1, 1.0)
    none = labels.label_distribution(events(spark, rows).limit(0)).first()
    assert none.candidate_event_count == 0 and none.positive_ratio == 0.0


def test_profile(spark):
    e = events(spark, [(0, "view", "a"), (1, "wishlist", "a"), ("not-a-time", "purchase", "b"), (3, None, None)])
    r = profile.profile(e).first()
    assert (r.row_count, r.event_time_parse_failures, r.purchase_event_count, r.purchase_session_count, r.unique_session_count) == (4, 1, 1, 1, 2)
    issues = {(x.issue, x["column"]): x.affected_count for x in profile.quality_issues(e).collect()}
    assert issues[("unexpected_event_type", "event_type")] == 1 and issues[("event_time_parse_failure", "event_time")] == 1
    lacking = {x.issue for x in profile.quality_issues(e.drop("brand")).collect()}
    assert "missing_required_column" in lacking
    clean = events(spark, [(0, "view", "a")]).withColumn("brand", F.lit("b"))
    assert [x.issue for x in profile.quality_issues(clean).collect()] == ["none"]
    assert {x.event_type: x["count"] for x in profile.event_type_distribution(e).collect()}["<missing>"] == 1


def test_quality(spark):
    rows = [(5, "view", "a"), (1, "view", "a"), ("bad-time", "view", "a"), (0, "view", "b", "0"), (2, "purchase", "b", "-5"), (2, "purchase", "b", "-5")]
    e = events(spark, rows)
    assert quality.duplicate_rows(e).first()[0] == 1
    assert tuple(quality.time_reversals(e).first()) == (1, 1)
    r = quality.row_checks(e).first()
    assert (r.price_zero_count, r.price_negative_count, r.event_time_parse_failures) == (1, 2, 1)
    extreme = quality.extreme_sessions(e, QualityPolicy(3)).collect()
    assert [(x.user_session, x.has_time_reversal) for x in extreme] == [("a", True), ("b", False)]
    checks = as_dict(quality.quality_summary(e, QualityPolicy(3)), "check")
    assert checks["price_positive"].affected_count == 3 and checks["schema_required_columns"].status == "pass" and checks["missing_brand"].status == "review"
    segments = as_dict(quality.session_comparison(e), "segment")
    assert segments["purchase"].avg_event_count == 3.0 and segments["non_purchase"].session_count == 1


def test_eda(spark):
    rows = [(0, "view", "a"), (1, "cart", "a"), (2, "purchase", "a"), (0, "view", "b"), (1, "cart", "b"), (0, "purchase", "c")]
    e = events(spark, rows)
    patterns = as_dict(eda.conversion_by_pattern(e), "sequence_pattern")
    assert patterns["view > cart"].purchase_rate == 0.5 and patterns["<empty>"].session_count == 1
    overview = {r.metric: r.value for r in eda.eda_overview(e, 30).collect()}
    assert overview["session_count"] == 3 and overview["labeled_sample_count"] == 4 and overview["positive_sample_count"] == 2
    assert eda.conversion_by_hour(e, 30).count() == 24 and eda.conversion_by_price_band(e, 30).count() == 8
    assert as_dict(eda.conversion_by_session_length(e), "session_length_band")["101+"].session_count == 0
    assert eda.category_conversion(e).first().purchase_to_view_rate == 1.0
    assert eda.sample_comparison(e, 30).count() == 2


def test_features_and_history(spark):
    rows = [(0, "view", "a", "5", "1"), (1, "cart", "a", None, "2"), (2, "view", "a", "7", "1"), (10, "view", "b", "9", "3"), (12, "purchase", "b", "9", "3")]
    policy = FeaturePolicy(train_ratio=0.5, validation_ratio=0.25)
    built = features.build_features(events(spark, rows), policy)
    table = as_dict(features.tabular_features(built, extended=True), "sample_id")
    third = table["sample_000000000002"]
    assert (third.prefix_length, third.event_count_view, third.event_count_cart, third.unique_product_count, third.last_price) == (3, 2, 1, 2, 7.0)
    second = table["sample_000000000001"]
    assert second.last_price == 5.0 and second.last_price_bin == "<missing>" and second.time_since_previous_event_minutes == 1.0
    fourth = table["sample_000000000003"]
    assert (fourth.user_past_event_count, fourth.user_past_cart_count, fourth.user_past_session_count, fourth.prefix_length) == (3, 1, 1, 1)
    assert len(table) == 4
    seq = as_dict(features.sequence_features(built), "sample_id")["sample_000000000001"]
    assert seq.event_type_sequence == "view cart" and seq.time_gap_minutes_sequence == "0.000000 1.000000" and seq.price_bin_sequence == "(-inf, 25] <missing>"
    assert {r.split for r in built.select("split").collect()} == {"train", "validation", "test"}
    assert features.split_summary(built).count() == 3
    scope = as_dict(features.transformer_scope(built), "feature_name")
    assert scope["last_event_type"].vocabulary == "cart|view"
    assert {r.status for r in features.leakage_checks(built).collect()} == {"pass"}


def test_sequence_length_and_no_leak(spark):
    rows = [(i, "view", "a") for i in range(6)]
    built = features.eligible(features.prefix_features(events(spark, rows), FeaturePolicy(max_sequence_length=3)))
    assert max(len(r.event_type_sequence.split()) for r in features.sequence_features(built).collect()) == 3


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["view", "cart", "purchase"]), st.sampled_from(["a", "b"])), min_size=2, max_size=8))
def test_later_events_leave_features_unchanged(spark, rows):
    columns = [c for c in features.TABULAR]
    whole = as_dict(features.tabular_features(features.prefix_features(events(spark, rows))).select(*columns), "sample_id")
    cut = sorted(r[0] for r in rows)[len(rows) // 2]
    kept = events(spark, rows).where(F.col("event_time") <= F.lit(dt.datetime(2019, 10, 1) + dt.timedelta(minutes=cut)).cast("timestamp_ntz"))
    for key, row in as_dict(features.tabular_features(features.prefix_features(kept)).select(*columns), "sample_id").items():
        assert row == whole[key]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 90), st.sampled_from(["view", "cart", "purchase"]), st.sampled_from(["a", "b", None])), min_size=1, max_size=10))
def test_distribution_is_the_sum_of_the_labels(spark, rows):
    e = events(spark, rows)
    table, wide = labels.prefix_labels(e).collect(), labels.label_distribution(e).first()
    assert wide.labeled_sample_count == len(table) and wide.positive_count == sum(r.label for r in table)


def test_until_and_renumbering(spark):
    e = events(spark, [("2019-10-01 23:59:59 UTC", "view", "a"), ("2019-10-02 00:00:00 UTC", "view", "a"), ("bad-time", "view", "a")])
    assert clickstream.until(e, "2019-10-01").count() == 1 and clickstream.until(e, "2019-10-02 00:00:00").count() == 2
    assert clickstream.until(e, "2019-10-02T02:00:00+02:00").count() == 2 and clickstream.until(e, None).count() == 3
    later = clickstream.renumbered(e.where("source_order > 0"), slices=2)
    assert sorted(r.source_order for r in later.collect()) == [0, 1]
    assert clickstream.first_rows(e, 2).count() == 2


def test_csv_source(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("event_time,event_type,product_id,category_id,price,user_id,user_session\n2019-10-01 00:00:00 UTC,view,2103807459595387724,NA,abc,1,s\n")
    r = clickstream.read_csv(spark, str(path)).first()
    assert r.product_id == 2103807459595387724 and r.category_id is None and r.price is None and r.brand is None and r.event_time is not None


def test_sequences(spark):
    kind = "sample_id string, split string, label int, event_type_sequence string, product_id_sequence string, category_id_sequence string, price_bin_sequence string, time_gap_minutes_sequence string"
    rows = [("s1", "train", 1, "view cart odd", "p1 p1 p2", "c c c", "b b b", "0.0 1.0 x"), ("s2", "test", 0, "purchase view", "p9 p1", "c d", "b b", "0 2"), ("s3", "validation", 0, "", "", "", "", "")]
    df = spark.createDataFrame(rows, kind)
    policy = SequencePolicy(max_sequence_length=4, vocabulary_top_k=1)
    vocabulary = {(r.sequence, r.token): r.token_id for r in sequences.token_vocabulary(df, policy).collect()}
    assert vocabulary[("event_type_sequence", "view")] == 2 and vocabulary[("event_type_sequence", "odd")] == 4
    assert vocabulary[("product_id_sequence", "p1")] == 2 and ("product_id_sequence", "p2") not in vocabulary
    encoded = as_dict(sequences.encoded_sequences(df, policy=policy), "sample_id")
    assert encoded["s2"].event_type_ids == [1, 2, 0, 0] and encoded["s2"].product_id_ids == [1, 2, 0, 0]
    assert encoded["s3"].sequence_length == 0 and encoded["s3"].event_type_ids == [0, 0, 0, 0]
    index, inputs = df.select("sample_id", "split", "label"), df.drop("split", "label")
    assert sequences.join_samples(index, inputs).count() == 3
    with pytest.raises(ValueError):
        sequences.join_samples(index, inputs.limit(2))
    with pytest.raises(ValueError):
        sequences.join_samples(index.union(index), inputs)
    assert sequences.stratified_cap(index, 1).count() == 1 and sequences.head_per_split(index, 1).count() == 3


def test_metrics(spark):
    rows = [("a", 1, 0.9), ("b", 1, 0.8), ("c", 0, 0.3), ("d", 0, 0.1)]
    perfect = spark.createDataFrame([("test", *r) for r in rows], "split string, sample_id string, label int, score double")
    r = metrics.evaluate(perfect).first()
    assert (r.pr_auc, r.roc_auc, r.f1, r.precision_at_k, r.recall_at_k) == (1.0, 1.0, 1.0, 1.0, 0.5)
    tied = perfect.withColumn("score", F.lit(0.5))
    r = metrics.evaluate(tied).first()
    assert (r.pr_auc, r.roc_auc, r.recall_at_k) == (0.5, 0.5, 0.5)
    one = metrics.evaluate(perfect.where("label = 0")).first()
    assert one.pr_auc is None and one.roc_auc is None and one.f1 == 0.0


def test_comparison(spark):
    kind = "model_name string, class_imbalance_strategy string, split string, sample_count long, positive_count long, pr_auc double, status string"
    rows = [("m", s_, p, 10, 2, v, "evaluated") for s_, p, v in (("none", "validation", 0.3), ("none", "test", 0.2), ("balanced", "validation", 0.4), ("balanced", "test", 0.1))]
    rows += [("gru", "pos_weight", "test", 11, 2, 0.9, "evaluated"), ("gru", "none", "test", 11, 2, None, "skipped")]
    df = spark.createDataFrame(rows, kind)
    best = as_dict(comparison.best_strategy(df), "model_name")
    assert best["m"].class_imbalance_strategy == "balanced" and best["gru"].selected_on == "test"
    final = comparison.final_comparison(df.where("model_name = 'm'"), df.where("model_name = 'gru'")).collect()
    assert [(r.split, r.model_name, r.sample_contract_status) for r in final] == [
        ("validation", "m", "single_model_only"), ("test", "gru", "mismatch_by_split_counts"), ("test", "m", "mismatch_by_split_counts"),
    ]
    assert comparison.test_metrics(df).first().model_name == "gru"
    history = spark.createDataFrame([(1, 0.5, 0.2), (2, 0.4, 0.3), (3, 0.3, 0.1)], "epoch int, train_loss double, validation_pr_auc double")
    trend = comparison.training_trend(history).first()
    assert (trend.best_epoch, trend.last_epoch, trend.loss_decreased) == (2, 3, True)


def test_models(spark):
    from clickloom.sources.clickstream import clickstream as table

    built = features.build_features(table(spark, "/root/testdata/sf0.001"), FeaturePolicy(360)).persist()
    found, importance = models.train_baselines(built, BaselinePolicy(strategies=("none", "balanced"), max_iter=20), ("logistic_regression",))
    assert found.count() == 6 and importance.count() > 20 and {r.status for r in found.collect()} == {"evaluated"}
    single, _ = models.train_baselines(built.withColumn("label", F.lit(0)), BaselinePolicy(strategies=("none",)), ("logistic_regression",))
    assert {r.status for r in single.collect()} == {"skipped_single_class"}


def test_artifacts(spark, tmp_path):
    e = events(spark, [(0, "view", "a"), (1, "cart", "a"), (20, "purchase", "a"), (0, "view", "b")])
    artifacts.write_profile(e, str(tmp_path / "p"))
    artifacts.write_quality(e, str(tmp_path / "q"))
    artifacts.write_labels(e, str(tmp_path / "l"))
    artifacts.write_eda(e, str(tmp_path / "e"))
    artifacts.write_features(e, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f/sequence_features")).count() == 3
    status = artifacts.artifact_status(spark, {"there": str(tmp_path / "f/samples"), "gone": str(tmp_path / "none")}).collect()
    assert [(r.name, r.present) for r in status] == [("gone", False), ("there", True)]


def test_feature_plan_has_two_exchanges(spark):
    from clickloom.sources.clickstream import clickstream as table

    plan = features.prefix_features(table(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan


def test_rows_of_several_files_are_in_order_of_names(spark, tmp_path):
    head = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session"
    for day, n in (("2019-10-01 a", 5), ("2019-10-02 b", 4000)):
        lines = [f"{day[:10]} 00:{i // 60 % 60:02d}:{i % 60:02d} UTC,view,{i},1,c,b,1.5,7,s{day[9]}" for i in range(n)]
        (tmp_path / f"{day}.csv").write_text("\n".join([head, *lines]) + "\n")
    rows = clickstream.read_csv(spark, str(tmp_path)).orderBy("source_order").collect()
    assert len({r.source_order for r in rows}) == 4005
    assert [r.product_id for r in rows] == [*range(5), *range(4000)]
    numbered = clickstream.renumbered(clickstream.read_csv(spark, str(tmp_path))).orderBy("source_order").collect()
    assert [r.source_order for r in numbered] == list(range(4005)) and [r.product_id for r in numbered] == [r.product_id for r in rows]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
def test_labels_do_not_follow_the_session_zone(spark, zone):
    """Times around a change of clocks, one of which doesn't exist in New York."""
    from clickloom.operators.labels import prefix_labels
    from clickloom.policies import LabelingPolicy

    rows = [(0, "2019-03-10 02:30:00", "view", "a"), (1, "2019-03-10 03:30:00", "purchase", "a"), (2, "2019-03-31 01:59:30", "view", "b"), (3, "2019-03-31 03:00:00", "purchase", "b")]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        events = spark.createDataFrame(rows, "source_order long, event_time string, event_type string, user_session string")
        events = events.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
        found = {r.user_session: (r.label, r.minutes_until_purchase) for r in prefix_labels(events, LabelingPolicy(prediction_window_minutes=90)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == {"a": (1, 60.0), "b": (1, 60.5)}


@pytest.mark.parametrize("most, cost", [("64m", "4194304"), ("134217728b", "0"), ("20k", "0"), ("30000", "1kb")])
def test_csv_order_under_any_file_settings(spark, tmp_path, most, cost):
    head = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session"
    for name, n in (("b", 3000), ("a", 2)):
        (tmp_path / f"{name}.csv").write_text("\n".join([head, *(f"2019-10-01 00:00:00 UTC,view,{i},1,c,b,1.5,7,s" for i in range(n))]) + "\n")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, value in zip(names, (most, cost)):
            spark.conf.set(n, value)
        rows = clickstream.read_csv(spark, str(tmp_path)).orderBy("source_order").collect()
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    assert len({r.source_order for r in rows}) == 3002 and [r.product_id for r in rows] == [0, 1, *range(3000)]


def test_medians_of_training_are_exact_without_a_buffer_a_column(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), int(b), None, None if i % 3 else float(c), 7.5) for i, (a, b, c) in enumerate(zip(rng.normal(size=5000), rng.integers(0, 4, 5000), rng.normal(size=5000)))]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double").repartition(5)
    for n in (5000, 1, 2, 7):
        some = df.limit(n).persist()
        for margin in (5e-4, 0.0):
            found = models.exact_medians(some, "abcde", margin)
            values = {c: [getattr(r, c) for r in some.collect() if getattr(r, c) is not None] for c in "abcde"}
            assert found == {c: float(np.median(v)) if v else None for c, v in values.items()}
    assert models.exact_medians(df.limit(0), "a") == {"a": None}


def test_strategies_are_evaluated_in_one_plan(spark, monkeypatch):
    from clickloom.sources.clickstream import clickstream as table

    calls, evaluate = [], models.evaluate
    monkeypatch.setattr(models, "evaluate", lambda *a: calls.append(a) or evaluate(*a))
    built = features.build_features(table(spark, "/root/testdata/sf0.001"), FeaturePolicy(360))
    found, _ = models.train_baselines(built, BaselinePolicy(strategies=("none", "balanced"), max_iter=5), ("logistic_regression",))
    assert len(calls) == 1 and found.count() == 6
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "Window" in line and "score#" in line and "_narrow" not in line]
    assert not whole
