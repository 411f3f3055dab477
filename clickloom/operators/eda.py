"""Exploratory conversion tables. Samples are the events before their session's first purchase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import LENGTH_BANDS, PRICE_BANDS, is_type, or_missing, price_band, ratio, session_length_band, top_level_category
from clickloom.operators.labels import first_purchase_time, valid_events, with_label


def samples(events: DataFrame, minutes: int) -> DataFrame:
    """Valid events before the first purchase, with label."""
    timed = valid_events(events).withColumn("first_purchase", first_purchase_time())
    before = timed.where(F.col("first_purchase").isNull() | (F.col("event_time") < F.col("first_purchase")))
    return with_label(before, minutes)


def sessions(events: DataFrame) -> DataFrame:
    """Valid sessions with their numbers of events and whether they purchase."""
    return valid_events(events).groupBy("user_session").agg(
        F.count(F.lit(1)).alias("event_count"), F.max(is_type(F.col("event_type"), "purchase")).alias("purchased")
    )


def _dense(found: DataFrame, key: str, values, counts: list[str]) -> DataFrame:
    """All values of a small domain, with 0 where `found` has none."""
    domain = found.sparkSession.createDataFrame([(v,) for v in values], f"{key} {'int' if isinstance(values[0], int) else 'string'}")
    return domain.join(found, key, "left").fillna(0, counts)


def eda_overview(events: DataFrame, minutes: int) -> DataFrame:
    """metric, value rows of sessions and samples."""
    per_session = sessions(events).agg(F.count(F.lit(1)).alias("session_count"), F.sum("purchased").alias("purchase_session_count"))
    per_sample = samples(events, minutes).agg(F.count(F.lit(1)).alias("labeled_sample_count"), F.count_if(F.col("label") == 1).alias("positive_sample_count"))
    wide = per_session.crossJoin(per_sample)
    values = {
        "session_count": F.col("session_count"),
        "purchase_session_count": F.coalesce("purchase_session_count", F.lit(0)),
        "labeled_sample_count": F.col("labeled_sample_count"),
        "positive_sample_count": F.col("positive_sample_count"),
        "negative_sample_count": F.col("labeled_sample_count") - F.col("positive_sample_count"),
        "positive_sample_ratio": F.round(ratio(F.col("positive_sample_count"), F.col("labeled_sample_count")), 6),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])
    return wide.select(F.explode(rows).alias("m")).select("m.metric", "m.value")


def conversion_by_session_length(events: DataFrame) -> DataFrame:
    """Sessions and purchase rate by length band; every band is there."""
    found = (
        sessions(events)
        .groupBy(session_length_band(F.col("event_count")).alias("session_length_band"))
        .agg(F.count(F.lit(1)).alias("session_count"), F.sum("purchased").alias("purchase_session_count"))
    )
    dense = _dense(found, "session_length_band", LENGTH_BANDS, ["session_count", "purchase_session_count"])
    return dense.withColumn("purchase_rate", F.round(ratio(F.col("purchase_session_count"), F.col("session_count")), 6))


def conversion_by_pattern(events: DataFrame, length: int = 5, top_n: int = 20) -> DataFrame:
    """The most frequent openings: the first types by position before the first purchase.

    Positions are ranked in the session, so at most `length` events are collected of each.
    """
    timed = valid_events(events).withColumn("first_purchase", first_purchase_time())
    opening = (F.col("event_type") != "purchase") | F.col("event_type").isNull()
    before = F.col("first_purchase").isNull() | (F.col("event_time") < F.col("first_purchase"))
    counted = timed.withColumn("_open", (opening & before).cast("int"))
    rank = F.row_number().over(Window.partitionBy("user_session").orderBy(F.desc("_open"), "source_order"))
    first = counted.withColumn("_rank", rank)
    item = F.when((F.col("_open") == 1) & (F.col("_rank") <= length), F.struct("_rank", F.coalesce("event_type", F.lit("nan")).alias("t")))
    per_session = first.groupBy("user_session").agg(
        F.array_sort(F.collect_list(item)).alias("_items"), F.max(is_type(F.col("event_type"), "purchase")).alias("purchased")
    )
    pattern = F.array_join(F.transform("_items", lambda x: x["t"]), " > ")
    return (
        per_session.groupBy(F.when(F.size("_items") == 0, "<empty>").otherwise(pattern).alias("sequence_pattern"))
        .agg(F.count(F.lit(1)).alias("session_count"), F.sum("purchased").alias("purchase_session_count"))
        .withColumn("purchase_rate", F.round(ratio(F.col("purchase_session_count"), F.col("session_count")), 6))
        .orderBy(F.desc("session_count"), "sequence_pattern")
        .limit(top_n)
    )


def _rates(found: DataFrame, key: Column, name: str) -> DataFrame:
    return found.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("label") == 1).alias("positive_count"), F.avg("price").alias("avg_price")
    )


def conversion_by_price_band(events: DataFrame, minutes: int) -> DataFrame:
    """Positive rate and mean price of samples by price band; every band is there."""
    dense = _dense(_rates(samples(events, minutes), price_band(F.col("price")), "price_band"), "price_band", PRICE_BANDS, ["sample_count", "positive_count"])
    return dense.withColumn("positive_rate", F.round(ratio(F.col("positive_count"), F.col("sample_count")), 6))


def conversion_by_hour(events: DataFrame, minutes: int) -> DataFrame:
    """Positive rate and mean price of samples by hour of the day; all 24 are there."""
    dense = _dense(_rates(samples(events, minutes), F.hour("event_time"), "hour"), "hour", list(range(24)), ["sample_count", "positive_count"])
    return dense.withColumn("positive_rate", F.round(ratio(F.col("positive_count"), F.col("sample_count")), 6))


def category_conversion(events: DataFrame, top_n: int = 20) -> DataFrame:
    """Events, views, purchases and their ratio by top-level category; the largest first."""
    return (
        valid_events(events)
        .groupBy(top_level_category(F.col("category_code")).alias("category"))
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_if(F.col("event_type") == "view").alias("view_events"),
            F.count_if(F.col("event_type") == "purchase").alias("purchase_events"),
        )
        .withColumn("purchase_to_view_rate", F.round(ratio(F.col("purchase_events"), F.col("view_events")), 6))
        .orderBy(F.desc("total_events"), "category")
        .limit(top_n)
    )


def sample_comparison(events: DataFrame, minutes: int) -> DataFrame:
    """Positive and negative samples: number, mean price, share of each event type."""
    segment = F.when(F.col("label") == 1, "positive").otherwise("negative")
    shares = [F.round(F.avg(is_type(or_missing(F.col("event_type")), t)), 6).alias(f"{t}_ratio") for t in ("view", "cart", "remove_from_cart", "purchase")]
    return samples(events, minutes).groupBy(segment.alias("label_segment")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("price").alias("avg_price"), *shares
    )


def interpretation(table: DataFrame, index: str, rate: str, count: str, part: str) -> DataFrame:
    """Best and worst band, their spread and the overall rate, of bands that hold anything."""
    return table.where(F.col(count) > 0).agg(
        F.max_by(index, rate).alias("best_band"),
        F.max(rate).alias("best_rate"),
        F.min_by(index, rate).alias("worst_band"),
        F.min(rate).alias("worst_rate"),
        F.round(F.max(rate) - F.min(rate), 6).alias("spread"),
        F.round(ratio(F.sum(part), F.sum(count)), 6).alias("overall_rate"),
    )
