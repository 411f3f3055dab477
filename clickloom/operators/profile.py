"""Dataset profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.scalars import or_missing, ratio
from clickloom.policies import EVENT_TYPES, REQUIRED_COLUMNS

_IDS = {"user_id": "unique_user_count", "user_session": "unique_session_count", "product_id": "unique_product_count", "category_id": "unique_category_count"}


def profile(events: DataFrame) -> DataFrame:
    """One row: counts, time range, exact distinct ids, purchase ratios. Null times count as failures."""
    purchase = F.col("event_type") == "purchase"
    counted = events.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("event_time").alias("event_time_min"),
        F.max("event_time").alias("event_time_max"),
        F.count_if(F.col("event_time").isNull()).alias("event_time_parse_failures"),
        F.count_if(purchase).alias("purchase_event_count"),
        F.countDistinct(F.when(purchase, F.col("user_session"))).alias("purchase_session_count"),
        *[F.countDistinct(c).alias(name) for c, name in _IDS.items()],
    )
    return counted.withColumn("purchase_event_ratio", F.round(ratio(F.col("purchase_event_count"), F.col("row_count")), 6)).withColumn(
        "purchase_session_ratio", F.round(ratio(F.col("purchase_session_count"), F.col("unique_session_count")), 6)
    )


def profile_summary(events: DataFrame) -> DataFrame:
    """The profile as metric, value rows, with the number of nulls of each column."""
    wide = profile(events)
    names = [c for c in wide.columns if not c.startswith("event_time_m")]
    text = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]
    return wide.select(F.explode(F.array(*text)).alias("m")).select("m.metric", "m.value")


def event_type_distribution(events: DataFrame) -> DataFrame:
    """event_type, count, ratio; the most frequent first, equal counts by name."""
    counted = events.groupBy(or_missing(F.col("event_type")).alias("event_type")).agg(F.count(F.lit(1)).alias("count"))
    total = events.agg(F.count(F.lit(1)).alias("_total"))
    return counted.crossJoin(F.broadcast(total)).select("event_type", "count", F.round(ratio(F.col("count"), F.col("_total")), 6).alias("ratio")).orderBy(F.desc("count"), "event_type")


def missing_values(events: DataFrame) -> DataFrame:
    """column, missing_count, missing_ratio for every required column."""
    counted = events.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[(F.count_if(F.col(c).isNull()) if c in events.columns else F.count(F.lit(1))).alias(c) for c in REQUIRED_COLUMNS],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count")) for c in REQUIRED_COLUMNS])
    return counted.select("_rows", F.explode(rows).alias("m")).select(
        "m.column", "m.missing_count", F.round(ratio(F.col("m.missing_count"), F.col("_rows")), 6).alias("missing_ratio")
    )


def quality_issues(events: DataFrame) -> DataFrame:
    """issue, severity, column, affected_count: absent columns, unexpected types, bad times, nulls; or `none`."""
    spark = events.sparkSession
    absent = [c for c in REQUIRED_COLUMNS if c not in events.columns]
    schema = "issue string, severity string, column string, affected_count long"
    fixed = spark.createDataFrame([("missing_required_column", "critical", c, 0) for c in absent], schema)
    present = [c for c in REQUIRED_COLUMNS if c not in absent]
    odd = F.col("event_type").isNotNull() & ~F.col("event_type").isin(*EVENT_TYPES) if "event_type" in present else F.lit(False)
    counted = events.agg(
        F.count_if(odd).alias("_odd"),
        (F.count_if(F.col("event_time").isNull()) if "event_time" in present else F.lit(0).cast("long")).alias("_failed"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in present],
    )

    def row(issue: str, severity: str, column: str, count: str):
        return F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.lit(column).alias("column"), F.col(count).alias("affected_count"))

    rows = [row("unexpected_event_type", "warning", "event_type", "_odd"), row("event_time_parse_failure", "warning", "event_time", "_failed")]
    rows += [row("missing_values", "info", c, c) for c in present]
    found = counted.select(F.filter(F.array(*rows), lambda r: r["affected_count"] > 0).alias("rows"))
    none = F.array(F.struct(F.lit("none").alias("issue"), F.lit("info").alias("severity"), F.lit("").alias("column"), F.lit(0).cast("long").alias("affected_count")))
    shown = F.when((F.size("rows") == 0) & F.lit(not absent), none).otherwise(F.col("rows"))
    return fixed.unionByName(found.select(F.explode(shown).alias("r")).select("r.*"))


def raw_preview(events: DataFrame, rows: int = 15) -> DataFrame:
    """The first rows by position."""
    return events.orderBy("source_order").limit(rows)
