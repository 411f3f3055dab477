"""Prefix labels and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clickloom.functions.scalars import iso_time, micros_between, minutes_between
from clickloom.policies import LabelingPolicy


def valid_events(events: DataFrame) -> DataFrame:
    """Events with a session and a valid time."""
    return events.where(F.col("user_session").isNotNull() & F.col("event_time").isNotNull())


def in_session() -> WindowSpec:
    """A session's events from its first to the current one."""
    return Window.partitionBy("user_session").orderBy("event_time", "source_order").rowsBetween(Window.unboundedPreceding, 0)


def first_purchase_time() -> Column:
    """The time of the session's first purchase, or null."""
    purchase = F.when(F.col("event_type") == "purchase", F.col("event_time"))
    return F.min(purchase).over(Window.partitionBy("user_session"))


def window_interval(minutes: int) -> Column:
    """A number of minutes as a day-time interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0.0))


def with_label(events: DataFrame, minutes: int, at: str = "first_purchase") -> DataFrame:
    """Adds label and minutes_until_purchase from a column with the time of a purchase."""
    purchase = F.col(at)
    inside = (purchase > F.col("event_time")) & (purchase <= F.col("event_time") + window_interval(minutes))
    hit = F.when(inside, purchase)
    return events.withColumn("label", hit.isNotNull().cast("int")).withColumn("minutes_until_purchase", minutes_between(F.col("event_time"), hit))


def prefix_labels(events: DataFrame, policy: LabelingPolicy = LabelingPolicy()) -> DataFrame:
    """A row per labelled prefix.

    The purchase is the next one after the cutoff, found in a window over the later events' times;
    events at or after the session's first purchase are left out after the windows if so set.
    """
    session = in_session()
    types = F.coalesce(F.col("event_type"), F.lit("nan"))
    tokens = F.collect_list("_type").over(session)
    prefix = tokens if policy.include_current_event_in_prefix else F.slice(tokens, F.lit(1), F.size(tokens) - 1)
    framed = (
        valid_events(events)
        .withColumn("_type", types)
        .withColumn("_at", micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("event_time")))
        .withColumn("session_position", F.row_number().over(Window.partitionBy("user_session").orderBy("event_time", "source_order")))
        .withColumn("_prefix", prefix)
        .withColumn("first_purchase", first_purchase_time())
    )
    ascending = Window.partitionBy("user_session").orderBy("_at").rangeBetween(1, Window.unboundedFollowing)
    framed = framed.withColumn("_next", F.min(F.when(F.col("_type") == "purchase", F.col("event_time"))).over(ascending))
    labelled = with_label(framed, policy.prediction_window_minutes, "_next")
    if policy.exclude_at_or_after_first_purchase:
        labelled = labelled.where(F.col("first_purchase").isNull() | (F.col("event_time") < F.col("first_purchase")))
    return labelled.select(
        "user_session",
        iso_time(F.col("event_time")).alias("cutoff_time"),
        "session_position",
        F.size("_prefix").alias("prefix_length"),
        F.array_join("_prefix", " ").alias("prefix_event_types"),
        F.col("_type").alias("last_event_type"),
        "label",
        "minutes_until_purchase",
    )


def label_distribution(events: DataFrame, policy: LabelingPolicy = LabelingPolicy()) -> DataFrame:
    """One row of counts: candidates, labelled samples, exclusions, sessions.

    The label looks at the session's first purchase only. Events without session count as such
    first, then those without valid time.
    """
    no_session = F.col("user_session").isNull()
    no_time = ~no_session & F.col("event_time").isNull()
    valid = F.col("user_session").isNotNull() & F.col("event_time").isNotNull()
    purchase = F.when(valid & (F.col("event_type") == "purchase"), F.col("event_time"))
    timed = events.where(valid).withColumn("first_purchase", F.min(purchase).over(Window.partitionBy("user_session")))
    after = F.col("first_purchase").isNotNull() & (F.col("event_time") >= F.col("first_purchase"))
    if not policy.exclude_at_or_after_first_purchase:
        after = F.lit(False)
    counted = with_label(timed, policy.prediction_window_minutes).agg(
        F.count_if(~after).alias("labeled_sample_count"),
        F.count_if(~after & (F.col("label") == 1)).alias("positive_count"),
        F.count_if(after).alias("excluded_at_or_after_first_purchase_count"),
        F.countDistinct("user_session").alias("session_count"),
        F.countDistinct(F.when(F.col("first_purchase").isNotNull(), F.col("user_session"))).alias("purchase_session_count"),
    )
    whole = events.agg(
        F.count(F.lit(1)).alias("candidate_event_count"),
        F.count_if(no_session).alias("excluded_missing_session_count"),
        F.count_if(no_time).alias("excluded_invalid_time_count"),
    )
    negative = F.col("labeled_sample_count") - F.col("positive_count")
    share = lambda part: F.round(F.coalesce(F.try_divide(part.cast("double"), F.col("labeled_sample_count").cast("double")), F.lit(0.0)), 6)
    return whole.crossJoin(counted).select(
        F.lit(policy.prediction_window_minutes).alias("prediction_window_minutes"),
        "candidate_event_count",
        "labeled_sample_count",
        "positive_count",
        negative.alias("negative_count"),
        share(F.col("positive_count")).alias("positive_ratio"),
        share(negative).alias("negative_ratio"),
        "excluded_missing_session_count",
        "excluded_invalid_time_count",
        "excluded_at_or_after_first_purchase_count",
        "session_count",
        "purchase_session_count",
    )


def label_policy(spark, policy: LabelingPolicy = LabelingPolicy()) -> DataFrame:
    """The labelling rules as a table."""
    return spark.createDataFrame(
        [
            ("prediction_window", f"{policy.prediction_window_minutes} minutes", "A purchase of the same session within the window after the cutoff is positive."),
            ("cutoff_interval", "(cutoff_time, cutoff_time + window]", "A purchase at the cutoff itself isn't in the future."),
            ("prefix_feature_scope", "events_at_or_before_cutoff", "Prefix features use events up to the cutoff only."),
            ("purchase_event_policy", "exclude_at_or_after_first_purchase" if policy.exclude_at_or_after_first_purchase else "keep_all", "Events from the first purchase on are left out as samples."),
        ],
        "policy string, value string, description string",
    )
