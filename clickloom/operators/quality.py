"""Data quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import is_type, minutes_between
from clickloom.operators.profile import missing_values
from clickloom.policies import EVENT_TYPES, REQUIRED_COLUMNS, QualityPolicy


def row_checks(events: DataFrame) -> DataFrame:
    """One row: time failures, event types out of the domain, and prices null, zero, negative, least and largest."""
    odd = F.col("event_type").isNotNull() & ~F.col("event_type").isin(*EVENT_TYPES)
    return events.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("event_time").isNull()).alias("event_time_parse_failures"),
        F.array_join(F.array_sort(F.collect_set(F.when(odd, F.col("event_type")))), "|").alias("unexpected_event_types"),
        F.count_if(F.col("price").isNull()).alias("price_null_count"),
        F.count_if(F.col("price") == 0).alias("price_zero_count"),
        F.count_if(F.col("price") < 0).alias("price_negative_count"),
        F.round(F.min("price"), 6).alias("price_min"),
        F.round(F.max("price"), 6).alias("price_max"),
    )


def duplicate_rows(events: DataFrame) -> DataFrame:
    """duplicate_row_count: rows less distinct rows over the required columns, null-safe and exact."""
    counted = events.groupBy(*REQUIRED_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"))


def session_stats(events: DataFrame) -> DataFrame:
    """A row per session: events, purchases, times, mean price, time reversals.

    Events without valid time count as events; a reversal is an event earlier than the last one
    before it, by position, that has a valid time.
    """
    known = events.where(F.col("user_session").isNotNull())
    by_position = Window.partitionBy("user_session").orderBy("source_order").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("event_time", ignorenulls=True).over(by_position)
    return (
        known.withColumn("_reversed", F.coalesce(F.col("event_time") < before, F.lit(False)))
        .groupBy("user_session")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.sum(is_type(F.col("event_type"), "purchase")).alias("purchase_count"),
            F.min("event_time").alias("first_time"),
            F.max("event_time").alias("last_time"),
            F.avg("price").alias("avg_price"),
            F.count_if("_reversed").alias("reversal_count"),
            F.min("source_order").alias("first_order"),
        )
        .withColumn("duration_minutes", minutes_between(F.col("first_time"), F.col("last_time")))
    )


def session_comparison(events: DataFrame) -> DataFrame:
    """Sessions with and without purchase: numbers, mean and median events and minutes, mean of mean prices."""
    segment = F.when(F.col("purchase_count") > 0, "purchase").otherwise("non_purchase")
    return (
        session_stats(events)
        .groupBy(segment.alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("session_count"),
            F.round(F.avg("event_count"), 6).alias("avg_event_count"),
            F.round(F.median("event_count"), 6).alias("median_event_count"),
            F.round(F.avg("duration_minutes"), 6).alias("avg_duration_minutes"),
            F.round(F.median("duration_minutes"), 6).alias("median_duration_minutes"),
            F.round(F.avg("avg_price"), 6).alias("avg_price_per_event"),
        )
    )


def extreme_sessions(events: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """The longest sessions from the threshold on; equal lengths by first position."""
    return (
        session_stats(events)
        .where(F.col("event_count") >= policy.extreme_session_threshold)
        .orderBy(F.desc("event_count"), "first_order")
        .limit(policy.top_n)
        .select("user_session", "event_count", "purchase_count", F.round("duration_minutes", 6).alias("duration_minutes"), (F.col("reversal_count") > 0).alias("has_time_reversal"))
    )


def time_reversals(events: DataFrame) -> DataFrame:
    """Events and sessions whose time runs backwards by position."""
    return session_stats(events).agg(
        F.coalesce(F.sum("reversal_count"), F.lit(0)).alias("reversal_event_count"),
        F.count_if(F.col("reversal_count") > 0).alias("reversal_session_count"),
    )


def session_limits(events: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """One row: sessions, purchase sessions, long sessions, longest and longest lasting session."""
    return session_stats(events).agg(
        F.count(F.lit(1)).alias("session_count"),
        F.count_if(F.col("purchase_count") > 0).alias("purchase_session_count"),
        F.count_if(F.col("event_count") >= policy.extreme_session_threshold).alias("extreme_session_count"),
        F.max("event_count").alias("max_session_event_count"),
        F.round(F.max("duration_minutes"), 6).alias("max_session_duration_minutes"),
    )


def quality_summary(events: DataFrame, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """check, status, affected_count: seven named checks and one per column."""
    absent = sum(c not in events.columns for c in REQUIRED_COLUMNS)
    rows = row_checks(events)
    parts = rows.crossJoin(duplicate_rows(events)).crossJoin(time_reversals(events)).crossJoin(session_limits(events, policy))
    odd = events.agg(F.count_if(F.col("event_type").isNotNull() & ~F.col("event_type").isin(*EVENT_TYPES)).alias("_odd"))
    counts = {
        "schema_required_columns": F.lit(absent).cast("long"),
        "event_time_parse": F.col("event_time_parse_failures"),
        "event_type_allowed_values": F.col("_odd"),
        "price_positive": F.col("price_zero_count") + F.col("price_negative_count"),
        "duplicate_rows": F.col("duplicate_row_count"),
        "session_time_order": F.col("reversal_event_count"),
        "extreme_session_length": F.col("extreme_session_count"),
    }
    named = parts.crossJoin(odd).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.cast("long").alias("affected_count")) for k, v in counts.items()])).alias("c")
    )
    columns = missing_values(events).select(F.concat(F.lit("missing_"), F.col("column")).alias("check"), F.col("missing_count").alias("affected_count"))
    return (
        named.select("c.check", "c.affected_count")
        .unionByName(columns)
        .select("check", F.when(F.col("affected_count") == 0, "pass").otherwise("review").alias("status"), "affected_count")
    )
