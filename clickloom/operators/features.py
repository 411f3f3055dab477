"""Prefix features, user history, sequences, time splits and what is fitted on the training part.

The plan has one exchange by session and one by user: windows with finer keys, such as
(session, product), reuse the exchange of their first key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import fixed6, is_type, iso_time, minutes_between, or_missing, price_band, ratio, sample_id
from clickloom.operators.labels import first_purchase_time, in_session, valid_events, with_label
from clickloom.policies import EVENT_TYPES, MISSING, SPLITS, FeaturePolicy

SAMPLE_INDEX = ("sample_id", "user_session", "user_id", "cutoff_time", "split", "label", "minutes_until_purchase")
NUMERIC_INPUTS = (
    "prefix_length", "session_elapsed_minutes", "time_since_previous_event_minutes", "hour", "event_count_view", "event_count_cart",
    "event_count_remove_from_cart", "unique_product_count", "unique_category_count", "last_price", "user_past_event_count",
    "user_past_purchase_count", "user_past_cart_count",
)
CATEGORICAL_INPUTS = ("last_event_type", "last_price_bin")
TABULAR = (
    "sample_id", "prefix_length", "last_event_type", "session_elapsed_minutes", "time_since_previous_event_minutes", "hour",
    "event_count_view", "event_count_cart", "event_count_remove_from_cart", "unique_product_count", "unique_category_count",
    "last_price", "last_price_bin", "user_past_event_count", "user_past_purchase_count", "user_past_cart_count",
)
SEQUENCES = ("event_type_sequence", "product_id_sequence", "category_id_sequence", "price_bin_sequence", "time_gap_minutes_sequence")
EXTENDED = (
    "session_position", "day_of_week", "event_count_purchase", "unique_brand_count", "avg_price", "max_price",
    "user_past_session_count", "user_minutes_since_last_event",
)


def _newly_seen(column: str, group: str, order: tuple[str, ...]) -> Column:
    """1 at the first event of a group with each value that isn't missing."""
    first = F.row_number().over(Window.partitionBy(group, column).orderBy(*order)) == 1
    return (first & (F.col(column) != MISSING)).cast("int")


def prefix_features(events: DataFrame, policy: FeaturePolicy = FeaturePolicy()) -> DataFrame:
    """Every valid event with its prefix features, user history, label and first purchase time.

    Post-purchase events stay, as history and split boundaries need them.
    """
    order = ("event_time", "source_order")
    session = in_session()
    start = Window.partitionBy("user_session").orderBy(*order)
    recent = start.rowsBetween(-(policy.max_sequence_length - 1), 0)
    base = (
        valid_events(events)
        .withColumn("event_type", F.coalesce("event_type", F.lit("nan")))
        .withColumn("_product", or_missing(F.col("product_id")))
        .withColumn("_category", or_missing(F.col("category_id")))
        .withColumn("_brand", or_missing(F.col("brand")))
        .withColumn("_user", or_missing(F.col("user_id")))
        .withColumn("last_price_bin", price_band(F.col("price")))
    )
    flagged = base.select(
        "*",
        first_purchase_time().alias("first_purchase"),
        _newly_seen("_product", "user_session", order).alias("_new_product"),
        _newly_seen("_category", "user_session", order).alias("_new_category"),
        _newly_seen("_brand", "user_session", order).alias("_new_brand"),
        F.lag("event_time").over(start).alias("_previous"),
    ).withColumn("time_since_previous_event_minutes", minutes_between(F.col("_previous"), F.col("event_time")))
    item = F.struct(
        F.col("event_type").alias("t"), F.col("_product").alias("p"), F.col("_category").alias("c"), F.col("last_price_bin").alias("b"),
        fixed6(F.col("time_since_previous_event_minutes")).alias("g"),
    )
    framed = flagged.select(
        "*",
        F.row_number().over(start).alias("session_position"),
        minutes_between(F.first("event_time").over(session), F.col("event_time")).alias("session_elapsed_minutes"),
        *[F.sum(is_type(F.col("event_type"), t)).over(session).cast("long").alias(f"event_count_{t}") for t in EVENT_TYPES],
        *[F.sum(f"_new_{n}").over(session).cast("long").alias(f"unique_{n}_count") for n in ("product", "category", "brand")],
        F.avg("price").over(session).alias("avg_price"),
        F.max("price").over(session).alias("max_price"),
        F.last("price", ignorenulls=True).over(session).alias("last_price"),
        F.collect_list(item).over(recent).alias("_items"),
    )
    by_user = Window.partitionBy("_user").orderBy(*order)
    past = by_user.rowsBetween(Window.unboundedPreceding, -1)
    new_session = (F.row_number().over(Window.partitionBy("_user", "user_session").orderBy(*order)) == 1).cast("int")
    history = framed.withColumn("_new_session", new_session).select(
        "*",
        F.count(F.lit(1)).over(past).alias("user_past_event_count"),
        F.coalesce(F.sum(is_type(F.col("event_type"), "purchase")).over(past), F.lit(0)).cast("long").alias("user_past_purchase_count"),
        F.coalesce(F.sum(is_type(F.col("event_type"), "cart")).over(past), F.lit(0)).cast("long").alias("user_past_cart_count"),
        F.coalesce(F.sum("_new_session").over(past), F.lit(0)).cast("long").alias("user_past_session_count"),
        minutes_between(F.lag("event_time").over(by_user), F.col("event_time")).alias("user_minutes_since_last_event"),
    )
    return (
        with_label(history, policy.prediction_window_minutes)
        .withColumn("sample_id", sample_id(F.col("source_order")))
        .withColumn("prefix_length", F.col("session_position"))
        .withColumn("last_event_type", F.col("event_type"))
        .withColumn("hour", F.hour("event_time"))
        .withColumn("day_of_week", F.weekday("event_time"))
        .withColumn("user_id", F.col("user_id").cast("string"))
    )


def eligible(features: DataFrame) -> DataFrame:
    """Samples: events before their session's first purchase."""
    return features.where(F.col("first_purchase").isNull() | (F.col("event_time") < F.col("first_purchase")))


def split_boundaries(samples: DataFrame, policy: FeaturePolicy = FeaturePolicy()) -> DataFrame:
    """One row: the first times up to which train, and train and validation, hold their share of samples.

    Samples are counted per time first, so the running sum has a row per distinct time only.
    """
    counted = samples.groupBy("event_time").agg(F.count(F.lit(1)).alias("n"))
    running = counted.select("event_time", F.sum("n").over(Window.orderBy("event_time")).alias("_upto"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    share = policy.train_ratio + policy.validation_ratio
    at = lambda r: F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") * F.lit(r)), F.col("event_time")))
    return running.agg(at(policy.train_ratio).alias("_train_end"), at(share).alias("_validation_end"))


def split_by_count(samples: DataFrame, policy: FeaturePolicy = FeaturePolicy()) -> DataFrame:
    """Adds split, by shares of the number of samples in time order."""
    split = F.when(F.col("event_time") <= F.col("_train_end"), "train").when(F.col("event_time") <= F.col("_validation_end"), "validation").otherwise("test")
    return samples.crossJoin(F.broadcast(split_boundaries(samples, policy))).withColumn("split", split).drop("_train_end", "_validation_end")


def split_by_distinct_time(samples: DataFrame, policy: FeaturePolicy = FeaturePolicy()) -> DataFrame:
    """Adds split, by shares of the number of distinct times: at least one for train, if possible one for validation."""
    times = samples.select("event_time").distinct().select("event_time", F.row_number().over(Window.orderBy("event_time")).alias("_rank"))
    total = F.max("_rank").over(Window.partitionBy())
    train = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(policy.train_ratio)))
    both = F.floor(F.col("_n") * F.lit(policy.train_ratio + policy.validation_ratio))
    validation = F.when(F.col("_n") > F.col("_t"), F.greatest(both, F.col("_t") + 1)).otherwise(F.col("_t"))
    placed = times.withColumn("_n", total).withColumn("_t", train).withColumn("_v", validation)
    split = F.when(F.col("_rank") <= F.col("_t"), "train").when(F.col("_rank") <= F.col("_v"), "validation").otherwise("test")
    return samples.join(placed.select("event_time", split.alias("split")), "event_time")


def build_features(events: DataFrame, policy: FeaturePolicy = FeaturePolicy(), by: str = "count") -> DataFrame:
    """All samples with split."""
    samples = eligible(prefix_features(events, policy))
    return split_by_count(samples, policy) if by == "count" else split_by_distinct_time(samples, policy)


def sample_index(features: DataFrame) -> DataFrame:
    """Keys, cutoff, split and target of the samples."""
    return features.withColumn("cutoff_time", iso_time(F.col("event_time"))).select(*SAMPLE_INDEX)


def tabular_features(features: DataFrame, extended: bool = False) -> DataFrame:
    """The tabular inputs; `extended` adds those that aren't model inputs."""
    return features.select(*TABULAR, *(EXTENDED if extended else ()))


def _joined_sequences() -> list[Column]:
    def joined(field: str) -> Column:
        return F.array_join(F.transform("_items", lambda x: x[field]), " ")

    return [joined(field).alias(name) for name, field in zip(SEQUENCES, "tpcbg")]


def sequence_features(features: DataFrame) -> DataFrame:
    """Five sequences of the last events as space-joined text."""
    return features.select("sample_id", *_joined_sequences())


def sequence_samples(features: DataFrame) -> DataFrame:
    """The sample index and the sequences of the same samples, without a join."""
    return features.withColumn("cutoff_time", iso_time(F.col("event_time"))).select(*SAMPLE_INDEX, *_joined_sequences())


def user_history(features: DataFrame) -> DataFrame:
    """What the user did strictly before the cutoff."""
    return features.select(
        "sample_id", "user_past_event_count", "user_past_purchase_count", "user_past_cart_count", "user_past_session_count", "user_minutes_since_last_event"
    )


def split_summary(features: DataFrame) -> DataFrame:
    """Samples, labels and time range of each split; always three rows."""
    found = features.groupBy("split").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum("label").alias("positive_count"),
        F.min("event_time").alias("_low"),
        F.max("event_time").alias("_high"),
    )
    domain = features.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return domain.join(found, "split", "left").fillna(0, ["sample_count", "positive_count"]).select(
        "split",
        "sample_count",
        "positive_count",
        (F.col("sample_count") - F.col("positive_count")).alias("negative_count"),
        F.round(ratio(F.col("positive_count"), F.col("sample_count")), 6).alias("positive_ratio"),
        iso_time(F.col("_low")).alias("cutoff_time_min"),
        iso_time(F.col("_high")).alias("cutoff_time_max"),
    )


def transformer_scope(features: DataFrame) -> DataFrame:
    """What encoders and scalers fit, on the training samples only, in one aggregate.

    feature_name, transformer_type, fit_split, train_observation_count, vocabulary, mean, std (population).
    """
    train = features.where(F.col("split") == "train")
    fits = [F.count(F.lit(1)).alias("_n")]
    fits += [F.array_join(F.array_sort(F.collect_set(c)), "|").alias(f"_v_{c}") for c in CATEGORICAL_INPUTS]
    for c in NUMERIC_INPUTS:
        x = F.col(c).cast("double")
        fits += [F.count(x).alias(f"_n_{c}"), F.avg(x).alias(f"_m_{c}"), F.stddev_pop(x).alias(f"_s_{c}")]
    none = F.lit(None).cast("double")
    rows = [
        F.struct(F.lit(c).alias("feature_name"), F.lit("categorical_vocab").alias("transformer_type"), F.col("_n").alias("n"), F.col(f"_v_{c}").alias("v"), none.alias("m"), none.alias("s"))
        for c in CATEGORICAL_INPUTS
    ] + [
        F.struct(F.lit(c).alias("feature_name"), F.lit("standard_scaler_stats").alias("transformer_type"), F.col(f"_n_{c}").alias("n"), F.lit(None).cast("string").alias("v"), F.col(f"_m_{c}").alias("m"), F.col(f"_s_{c}").alias("s"))
        for c in NUMERIC_INPUTS
    ]
    return train.agg(*fits).select(F.explode(F.array(*rows)).alias("r")).select(
        "r.feature_name",
        "r.transformer_type",
        F.lit("train").alias("fit_split"),
        F.col("r.n").alias("train_observation_count"),
        F.col("r.v").alias("vocabulary"),
        F.round("r.m", 5).alias("mean"),
        F.round("r.s", 5).alias("std"),
    )


def feature_dictionary(spark) -> DataFrame:
    """Every feature with its group, type and role."""
    rows = [
        ("sample_id", "identifier", "string", "key"), ("user_session", "identifier", "string", "key"), ("user_id", "identifier", "string", "audit_only"),
        ("cutoff_time", "time", "datetime", "audit_only"), ("split", "split", "string", "audit_only"), ("label", "target", "integer", "target"),
        ("minutes_until_purchase", "target_diagnostic", "float", "audit_only"),
    ]
    kind = lambda c: "category" if c in CATEGORICAL_INPUTS else "float" if "minutes" in c or "price" in c else "integer"
    rows += [(c, "tabular", kind(c), "tabular_input") for c in TABULAR[1:]]
    rows += [(c, "sequence", "string_sequence", "sequence_input") for c in SEQUENCES]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, feature_name string, feature_group string, dtype string, model_role string")


def training_dictionary(dictionary: DataFrame) -> DataFrame:
    """Model inputs only: tabular ones, then sequences, each in their order."""
    order = F.when(F.col("model_role") == "tabular_input", 0).otherwise(1)
    return dictionary.where(F.col("model_role").isin("tabular_input", "sequence_input")).orderBy(order, "position")


def leakage_checks(features: DataFrame) -> DataFrame:
    """check, status, violations: what an input could know of the sample's future, counted in one pass.

    Raw keys and times are no inputs; sequences hold no more than the prefix; no sample lies at or
    after a purchase; user history ends before the cutoff; encoders are fitted on a training split
    that ends before the others begin; every sample has an id, which both kinds of inputs share.
    """
    inputs = {*TABULAR[1:], *SEQUENCES}
    fixed = lambda column: F.lit(int(column in inputs)).cast("long")
    late = F.max(F.when(F.col("split") == "train", F.col("event_time"))) >= F.min(F.when(F.col("split") != "train", F.col("event_time")))
    found = [
        ("raw_user_id_excluded", fixed("user_id")),
        ("raw_user_session_key_only", fixed("user_session")),
        ("raw_event_time_excluded", fixed("event_time")),
        ("prefix_scope", F.count_if(F.size("_items") > F.col("prefix_length"))),
        ("post_purchase_excluded", F.count_if(F.col("event_time") >= F.col("first_purchase"))),
        ("user_history_scope", F.count_if((F.col("user_minutes_since_last_event") < 0) | (F.col("user_past_session_count") > F.col("user_past_event_count")))),
        ("transformer_fit_scope", F.coalesce(late.cast("long"), F.lit(0).cast("long"))),
        ("common_sample_contract", F.count_if(F.col("sample_id").isNull())),
    ]
    counted = features.agg(*[count.alias(name) for name, count in found])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).cast("long").alias("violations")) for name, _ in found])
    return counted.select(F.inline(rows)).select("check", F.when(F.col("violations") == 0, "pass").otherwise("fail").alias("status"), "violations")
