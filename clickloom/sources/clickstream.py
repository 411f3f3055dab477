"""The canonical clickstream: from CSV files, and from the generic events table.

Canonical columns: source_order (position, the tie-break everywhere), event_time (zone-free UTC),
event_type, product_id, category_id, category_code, brand, price, user_id, user_session.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.scalars import parse_event_time, parse_number
from clickloom.policies import REQUIRED_COLUMNS

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in REQUIRED_COLUMNS])
#: Texts that a CSV cell may hold for null.
NULL_TEXTS = ("", "NA", "N/A", "n/a", "null", "NULL", "NaN", "nan", "None", "<NA>", "#N/A", "#NA", "-NaN", "-nan", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A")
_IDS = ("product_id", "category_id", "user_id")


def _bytes(text: str) -> int:
    """A size setting of Spark (134217728b, 64m, 1g, 0) in bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit.lower()[:1]]


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header as text columns and source_order; null texts become null.

    Columns are taken by name, absent ones are null and further ones are left out. source_order
    rises with the file's name, then with the place in it: 15 bits of the file, 18 of the part of
    the file that is read at once and 30 of the row. Parts begin at least as far apart as the session's
    file settings say (4 MB by default); with settings below 1 MB they are counted in a pass of their
    own. A file of more than 2^18 parts (1 TB by default) is an error.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    files = sorted(raw.inputFiles())
    if len(files) > 1 << 15:
        raise ValueError(f"{len(files)} files: read at most {1 << 15} at once, or merge small ones first")
    # The two listings may write file:/ and file:/// for the same file.
    known = spark.createDataFrame([(re.sub("^([a-z0-9]+):/+", r"\1:/", name), i) for i, name in enumerate(files)], "_path string, _file long")
    apart = min(1 << 22, *(_bytes(spark.conf.get(f"spark.sql.files.{name}")) for name in ("openCostInBytes", "maxPartitionBytes")))
    row = F.monotonically_increasing_id().bitwiseAND((1 << 30) - 1)
    begin = F.col("_metadata.file_block_start")
    path_of = F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/").alias("_path")
    raw = raw.select("*", path_of, begin.alias("_begin"), row.alias("_at"))
    if apart >= 1 << 20:
        raw = raw.withColumn("_part", F.floor(F.col("_begin") / apart))
    else:
        ranked = F.row_number().over(Window.partitionBy("_path").orderBy("_begin")) - 1
        raw = raw.join(raw.select("_path", "_begin").distinct().withColumn("_part", ranked.cast("long")), ["_path", "_begin"])
    too_long = F.raise_error(F.concat(F.lit("too long to be read in order, split it: "), F.col("_path")))
    raw = raw.withColumn("_part", F.when(F.col("_part") < 1 << 18, F.col("_part")).otherwise(too_long)).join(F.broadcast(known), "_path")
    order = F.shiftleft(F.col("_file"), 48) + F.shiftleft(F.col("_part"), 30) + F.col("_at")
    columns = [
        (F.when(F.col(c).isin(*NULL_TEXTS), None).otherwise(F.col(c)) if c in raw.columns else F.lit(None).cast("string")).alias(c)
        for c in REQUIRED_COLUMNS
    ]
    return raw.select(order.alias("source_order"), *columns)


def canonical(raw: DataFrame) -> DataFrame:
    """Typed canonical columns of a raw frame; bad values become null and absent columns are null."""

    def typed(name: str) -> Column:
        if name not in raw.columns:
            return F.lit(None).cast("string")
        return F.col(name)

    order = F.col("source_order") if "source_order" in raw.columns else F.monotonically_increasing_id()
    time = F.col("event_time") if dict(raw.dtypes).get("event_time") == "timestamp_ntz" else parse_event_time(typed("event_time"))
    return raw.select(
        order.cast("long").alias("source_order"),
        time.alias("event_time"),
        typed("event_type").cast("string").alias("event_type"),
        *[typed(c).try_cast("long").alias(c) for c in ("product_id", "category_id")],
        typed("category_code").cast("string").alias("category_code"),
        typed("brand").cast("string").alias("brand"),
        parse_number(typed("price")).alias("price"),
        typed("user_id").try_cast("long").alias("user_id"),
        typed("user_session").cast("string").alias("user_session"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The canonical clickstream of a CSV file."""
    return canonical(read_raw_csv(spark, path))


def until_bound(until: str | dt.datetime | None) -> tuple[dt.datetime, bool] | None:
    """A bound in UTC and whether it is itself included.

    A bare date includes that whole day, so its bound is the next midnight, excluded. Times without
    a zone are UTC; others are converted.
    """
    if until is None:
        return None
    if isinstance(until, str):
        text = until.strip()
        if len(text) == 10:
            return dt.datetime.fromisoformat(text) + dt.timedelta(days=1), False
        until = dt.datetime.fromisoformat(text.replace("Z", "+00:00").replace(" UTC", "+00:00"))
    if until.tzinfo is not None:
        until = until.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return until, True


def until(events: DataFrame, bound: str | dt.datetime | None) -> DataFrame:
    """Events up to a bound; with one, events without a valid time are left out."""
    found = until_bound(bound)
    if found is None:
        return events
    limit, included = found
    literal = F.lit(limit.isoformat(sep=" ")).cast("timestamp_ntz")
    return events.where(F.col("event_time") <= literal if included else F.col("event_time") < literal)


def first_rows(events: DataFrame, count: int | None) -> DataFrame:
    """The first rows by source_order, as a top-k that each task cuts first."""
    return events if count is None else events.orderBy("source_order").limit(count)


def renumbered(events: DataFrame, slices: int = 64) -> DataFrame:
    """source_order as 0, 1, 2, … without moving all rows to one task.

    Positions are dealt into ranges; each is numbered on its own and shifted by the sizes of those
    before it.
    """
    low, high = events.agg(F.min("source_order"), F.max("source_order")).first()
    if low is None:
        return events
    width = max(1, (high - low) // slices + 1)
    part = F.floor((F.col("source_order") - low) / width)
    sized = events.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("_part").count().withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    number = F.row_number().over(Window.partitionBy("_part").orderBy("source_order")) - 1
    return (
        sized.withColumn("_number", number)
        .join(offsets, "_part")
        .withColumn("source_order", F.col("_offset") + F.col("_number"))
        .select(*events.columns)
    )


def clickstream(spark: SparkSession, sf_dir: str, session_by_user: bool = False) -> DataFrame:
    """The events table as a canonical clickstream; a session is a user's day, or a user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("long")
    user = F.col("user_id").cast("string")
    session = user if session_by_user else F.concat(user, F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    kind = F.when(F.col("event_type") == "click", "cart").when(F.col("event_type") == "error", "remove_from_cart").otherwise(F.col("event_type"))
    return events.withColumn("_k", k).select(
        F.col("event_id").alias("source_order"),
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("event_time"),
        kind.alias("event_type"),
        F.col("_k").alias("product_id"),
        (F.col("_k") % 10).alias("category_id"),
        F.when(F.col("_k") % 7 != 0, F.concat(F.lit("cat"), (F.col("_k") % 10).cast("string"), F.lit(".sub"), (F.col("_k") % 3).cast("string"))).alias("category_code"),
        F.when(F.col("_k") % 5 != 0, F.concat(F.lit("brand_"), (F.col("_k") % 12).cast("string"))).alias("brand"),
        F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("price"),
        F.col("user_id"),
        session.alias("user_session"),
    )


def clickstream_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw form with defects: bad times, null sessions, odd prices, repeated rows, shuffled order."""
    clean = clickstream(spark, sf_dir)
    n = F.col("source_order")
    raw = clean.select(
        n.alias("event_id"),
        F.when(n % 997 == 0, "bad-time").otherwise(F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).alias("event_time"),
        "event_type",
        "product_id",
        "category_id",
        "category_code",
        "brand",
        F.when(n % 97 == 0, 0.0).when(n % 101 == 0, -F.col("price")).otherwise(F.col("price")).alias("price"),
        "user_id",
        F.when(n % 1009 != 0, F.col("user_session")).alias("user_session"),
    )
    copies = F.when(F.col("event_id") % 333 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return raw.withColumn("_copy", F.explode(copies)).select(
        ((F.col("event_id") * 2 + F.col("_copy")) * 7919 % 2000003).alias("source_order"), *REQUIRED_COLUMNS
    )


#: The same tables as common table expressions over `events`.
CLICKSTREAM_SQL = """
clickstream AS (
  SELECT event_id AS source_order, date_trunc('second', ts) AS event_time,
         CASE event_type WHEN 'click' THEN 'cart' WHEN 'error' THEN 'remove_from_cart' ELSE event_type END AS event_type,
         k AS product_id, k % 10 AS category_id,
         CASE WHEN k % 7 <> 0 THEN concat('cat', k % 10, '.sub', k % 3) END AS category_code,
         CASE WHEN k % 5 <> 0 THEN concat('brand_', k % 12) END AS brand,
         CASE WHEN event_id % 50 <> 0 THEN value END AS price, user_id,
         concat(user_id, '-', strftime(ts, '%Y-%m-%d')) AS user_session
  FROM (SELECT *, CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS BIGINT) AS k FROM events)
)"""
DIRTY_SQL = (
    CLICKSTREAM_SQL
    + """, raw AS (
  SELECT ((c.source_order * 2 + copy) * 7919) % 2000003 AS source_order,
         CASE WHEN c.source_order % 997 = 0 THEN 'bad-time' ELSE strftime(event_time, '%Y-%m-%d %H:%M:%S') || ' UTC' END AS event_time,
         event_type, product_id, category_id, category_code, brand,
         CASE WHEN c.source_order % 97 = 0 THEN 0.0::DOUBLE WHEN c.source_order % 101 = 0 THEN -price ELSE price END AS price, user_id,
         CASE WHEN c.source_order % 1009 <> 0 THEN user_session END AS user_session
  FROM clickstream c CROSS JOIN (VALUES (0), (1)) t(copy) WHERE copy = 0 OR c.source_order % 333 = 0
), dirty AS (
  SELECT * REPLACE (TRY_CAST(CASE WHEN event_time LIKE '% UTC' THEN replace(event_time, ' UTC', '') END AS TIMESTAMP) AS event_time) FROM raw
)"""
)
