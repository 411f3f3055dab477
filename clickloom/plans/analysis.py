"""Scalars, profile, quality, labels and exploratory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.functions import scalars as s
from clickloom.operators import eda, labels, profile, quality
from clickloom.policies import EVENT_TYPES, REQUIRED_COLUMNS, LabelingPolicy, QualityPolicy
from clickloom.sources.clickstream import CLICKSTREAM_SQL, DIRTY_SQL, canonical, clickstream, clickstream_dirty, until

WINDOW = 360
_LONG = QualityPolicy(extreme_session_threshold=5, top_n=20)


def _dirty(spark, sf_dir):
    return canonical(clickstream_dirty(spark, sf_dir))


def _mean(table):
    """Mean prices rounded a hair above halves, which engines round differently."""
    return table.withColumn("avg_price", F.round(F.col("avg_price") + 1e-9, 6))


def _scalars(spark, sf_dir):
    e = clickstream(spark, sf_dir)
    return e.select(
        "source_order", s.price_band(F.col("price")).alias("price_band"), s.top_level_category(F.col("category_code")).alias("category"),
        F.hour("event_time").alias("hour"), F.weekday("event_time").alias("weekday"), s.or_missing(F.col("brand")).alias("brand"),
        s.sample_id(F.col("source_order")).alias("sample_id"), s.iso_time(F.col("event_time")).alias("cutoff_time"),
    )


def _parsed(spark, sf_dir):
    found = until(_dirty(spark, sf_dir), "2024-01-10")
    return found.select("source_order", s.iso_time(F.col("event_time")).alias("event_time"), "price")


QUERIES = {
    "raw_preview": lambda spark, d: profile.raw_preview(clickstream(spark, d)).withColumn("event_time", s.iso_time(F.col("event_time"))),
    "parse_time_filter": _parsed,
    "scalar_projection": _scalars,
    "prefix_labels": lambda spark, d: labels.prefix_labels(clickstream(spark, d), LabelingPolicy(WINDOW)),
    "prefix_labels_30": lambda spark, d: labels.prefix_labels(clickstream(spark, d)),
    "prefix_labels_exclude_current": lambda spark, d: labels.prefix_labels(clickstream(spark, d), LabelingPolicy(WINDOW, include_current_event_in_prefix=False)),
    "prefix_labels_any_purchase": lambda spark, d: labels.prefix_labels(clickstream(spark, d), LabelingPolicy(WINDOW, exclude_at_or_after_first_purchase=False)),
    "label_distribution": lambda spark, d: labels.label_distribution(_dirty(spark, d), LabelingPolicy(WINDOW)),
    "profile_wide": lambda spark, d: profile.profile(_dirty(spark, d)).withColumn("event_time_min", s.iso_time(F.col("event_time_min"))).withColumn("event_time_max", s.iso_time(F.col("event_time_max"))),
    "profile_summary": lambda spark, d: profile.profile_summary(_dirty(spark, d)),
    "event_type_distribution": lambda spark, d: profile.event_type_distribution(_dirty(spark, d)),
    "missing_values": lambda spark, d: profile.missing_values(_dirty(spark, d)),
    "quality_issue_draft": lambda spark, d: profile.quality_issues(_dirty(spark, d)),
    "quality_row_checks": lambda spark, d: quality.row_checks(_dirty(spark, d)),
    "duplicate_rows": lambda spark, d: quality.duplicate_rows(_dirty(spark, d)),
    "session_stats": lambda spark, d: quality.session_stats(_dirty(spark, d)).select("user_session", "event_count", "purchase_count", F.round("avg_price", 6).alias("avg_price"), "reversal_count", "first_order", F.round("duration_minutes", 6).alias("duration_minutes")),
    "session_comparison": lambda spark, d: quality.session_comparison(_dirty(spark, d)),
    "extreme_sessions": lambda spark, d: quality.extreme_sessions(_dirty(spark, d), _LONG),
    "time_reversals": lambda spark, d: quality.time_reversals(_dirty(spark, d)),
    "quality_summary": lambda spark, d: quality.quality_summary(_dirty(spark, d), _LONG),
    "eda_overview": lambda spark, d: eda.eda_overview(clickstream(spark, d), WINDOW),
    "conversion_by_session_length": lambda spark, d: eda.conversion_by_session_length(clickstream(spark, d)),
    "conversion_by_pattern": lambda spark, d: eda.conversion_by_pattern(clickstream(spark, d)),
    "conversion_by_price_band": lambda spark, d: _mean(eda.conversion_by_price_band(clickstream(spark, d), WINDOW)),
    "conversion_by_hour": lambda spark, d: _mean(eda.conversion_by_hour(clickstream(spark, d), WINDOW)),
    "category_conversion": lambda spark, d: eda.category_conversion(clickstream(spark, d)),
    "sample_comparison": lambda spark, d: _mean(eda.sample_comparison(clickstream(spark, d), WINDOW)),
    "eda_interpretation": lambda spark, d: eda.interpretation(eda.conversion_by_session_length(clickstream(spark, d)), "session_length_band", "purchase_rate", "session_count", "purchase_session_count"),
}

_BAND = """CASE WHEN price IS NULL THEN '<missing>' WHEN price <= 25 THEN '(-inf, 25]' WHEN price <= 50 THEN '(25, 50]' WHEN price <= 100 THEN '(50, 100]'
  WHEN price <= 250 THEN '(100, 250]' WHEN price <= 500 THEN '(250, 500]' WHEN price <= 1000 THEN '(500, 1000]' ELSE '(1000, inf)' END"""
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"
_CATEGORY = "coalesce(nullif(split_part(category_code, '.', 1), ''), '<missing>')"
_C, _D = f"WITH {CLICKSTREAM_SQL}", f"WITH {DIRTY_SQL}"
_ALLOWED = ", ".join(f"'{t}'" for t in EVENT_TYPES)
_MINUTES = "(epoch_us({1}) - epoch_us({0})) / 60000000.0::DOUBLE"


def _labels(minutes: int, exclude: bool = True, current: bool = True) -> str:
    prefix = "string_agg(coalesce(event_type, 'nan'), ' ') OVER (PARTITION BY user_session ORDER BY event_time, source_order ROWS BETWEEN UNBOUNDED PRECEDING AND {} )"
    return f"""{_C}, v AS (SELECT * FROM clickstream WHERE user_session IS NOT NULL AND event_time IS NOT NULL), w AS (
      SELECT *, row_number() OVER (PARTITION BY user_session ORDER BY event_time, source_order) AS session_position,
             coalesce({prefix.format('CURRENT ROW' if current else '1 PRECEDING')}, '') AS prefix_event_types,
             min(CASE WHEN event_type = 'purchase' THEN event_time END) OVER (PARTITION BY user_session) AS fp,
             (SELECT min(p.event_time) FROM v p WHERE p.user_session = v.user_session AND p.event_type = 'purchase'
                AND p.event_time > v.event_time AND p.event_time <= v.event_time + INTERVAL {minutes} MINUTE) AS nxt
      FROM v)
    SELECT user_session, {_ISO.format('event_time')} AS cutoff_time, session_position, (session_position - {0 if current else 1})::INT AS prefix_length,
           prefix_event_types, event_type AS last_event_type, (nxt IS NOT NULL)::INT AS label, {_MINUTES.format('event_time', 'nxt')} AS minutes_until_purchase
    FROM w WHERE {'fp IS NULL OR event_time < fp' if exclude else 'true'}"""


_SAMPLES = f"""{_C}, t AS (
  SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_time END) OVER (PARTITION BY user_session) AS fp FROM clickstream
  WHERE user_session IS NOT NULL AND event_time IS NOT NULL
), samples AS (
  SELECT *, coalesce(fp > event_time AND fp <= event_time + INTERVAL {WINDOW} MINUTE, false)::INT AS label FROM t WHERE fp IS NULL OR event_time < fp
), sess AS (
  SELECT user_session, count(*) AS n, max((event_type = 'purchase')::INT) AS purchased FROM t GROUP BY 1
)"""
_STATS = f"""{_D}, r AS (
  SELECT *, coalesce(event_time < last_value(event_time IGNORE NULLS) OVER (PARTITION BY user_session ORDER BY source_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS rev
  FROM dirty WHERE user_session IS NOT NULL
), st AS (
  SELECT user_session, count(*) AS event_count, sum((event_type = 'purchase')::INT)::BIGINT AS purchase_count, avg(price) AS avg_price,
         sum(rev::INT)::BIGINT AS reversal_count, min(source_order) AS first_order,
         {_MINUTES.format('min(event_time)', 'max(event_time)')} AS duration_minutes
  FROM r GROUP BY 1
)"""
_RATE = "SELECT d.{k}, coalesce(f.sample_count, 0) AS sample_count, coalesce(f.positive_count, 0) AS positive_count, f.avg_price, round(coalesce(f.positive_count::DOUBLE / f.sample_count, 0), 6) AS positive_rate FROM d LEFT JOIN f USING ({k})"
_LENGTH = """CASE WHEN n <= 1 THEN '1' WHEN n <= 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE '101+' END"""
_BY_LENGTH = f"""{_SAMPLES}, d AS (SELECT unnest(['1', '2', '3-5', '6-10', '11-20', '21-50', '51-100', '101+']) AS session_length_band), f AS (
  SELECT {_LENGTH} AS session_length_band, count(*) AS session_count, sum(purchased)::BIGINT AS purchase_session_count FROM sess GROUP BY 1
), bl AS (
  SELECT session_length_band, coalesce(session_count, 0) AS session_count, coalesce(purchase_session_count, 0) AS purchase_session_count,
         round(coalesce(purchase_session_count::DOUBLE / session_count, 0), 6) AS purchase_rate FROM d LEFT JOIN f USING (session_length_band)
)"""
_PROFILE = f"""{_D}, p AS (
  SELECT count(*) AS row_count, {_ISO.format('min(event_time)')} AS event_time_min, {_ISO.format('max(event_time)')} AS event_time_max,
         count(*) FILTER (event_time IS NULL) AS event_time_parse_failures, count(*) FILTER (event_type = 'purchase') AS purchase_event_count,
         count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_session END) AS purchase_session_count,
         count(DISTINCT user_id) AS unique_user_count, count(DISTINCT user_session) AS unique_session_count,
         count(DISTINCT product_id) AS unique_product_count, count(DISTINCT category_id) AS unique_category_count FROM dirty
), pp AS (
  SELECT *, round(purchase_event_count::DOUBLE / row_count, 6) AS purchase_event_ratio, round(purchase_session_count::DOUBLE / unique_session_count, 6) AS purchase_session_ratio FROM p
)"""
_NUMBERS = ("row_count", "event_time_parse_failures", "purchase_event_count", "purchase_session_count", "unique_user_count", "unique_session_count", "unique_product_count", "unique_category_count", "purchase_event_ratio", "purchase_session_ratio")
_MISSING = f"""{_D}, n AS (SELECT count(*) AS rows_, {', '.join(f'count(*) FILTER ({c} IS NULL) AS {c}' for c in REQUIRED_COLUMNS)} FROM dirty), mv AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS column_, {c} AS missing_count, rows_ FROM n" for c in REQUIRED_COLUMNS)}
)"""

ORACLE_SQL = {
    "raw_preview": f"{_C} SELECT * REPLACE ({_ISO.format('event_time')} AS event_time) FROM clickstream ORDER BY source_order LIMIT 15",
    "parse_time_filter": f"{_D} SELECT source_order, {_ISO.format('event_time')} AS event_time, price FROM dirty WHERE event_time < TIMESTAMP '2024-01-11'",
    "scalar_projection": f"""{_C} SELECT source_order, {_BAND} AS price_band, {_CATEGORY} AS category, hour(event_time)::INT AS hour, (isodow(event_time) - 1)::INT AS weekday,
        coalesce(brand, '<missing>') AS brand, format('sample_{{:012d}}', source_order) AS sample_id, {_ISO.format('event_time')} AS cutoff_time FROM clickstream""",
    "prefix_labels": _labels(WINDOW),
    "prefix_labels_30": _labels(30),
    "prefix_labels_exclude_current": _labels(WINDOW, current=False),
    "prefix_labels_any_purchase": _labels(WINDOW, exclude=False),
    "label_distribution": f"""{_D}, t AS (
        SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_time END) OVER (PARTITION BY user_session) AS fp FROM dirty WHERE user_session IS NOT NULL AND event_time IS NOT NULL
      ), l AS (SELECT *, fp IS NOT NULL AND event_time >= fp AS after, coalesce(fp > event_time AND fp <= event_time + INTERVAL {WINDOW} MINUTE, false) AS pos FROM t), a AS (
        SELECT count(*) FILTER (NOT after) AS labeled_sample_count, count(*) FILTER (NOT after AND pos) AS positive_count, count(*) FILTER (after) AS excluded_at_or_after_first_purchase_count,
               count(DISTINCT user_session) AS session_count, count(DISTINCT CASE WHEN fp IS NOT NULL THEN user_session END) AS purchase_session_count FROM l
      ), b AS (SELECT count(*) AS candidate_event_count, count(*) FILTER (user_session IS NULL) AS excluded_missing_session_count,
               count(*) FILTER (user_session IS NOT NULL AND event_time IS NULL) AS excluded_invalid_time_count FROM dirty)
      SELECT {WINDOW} AS prediction_window_minutes, candidate_event_count, labeled_sample_count, positive_count, labeled_sample_count - positive_count AS negative_count,
             round(positive_count::DOUBLE / labeled_sample_count, 6) AS positive_ratio, round((labeled_sample_count - positive_count)::DOUBLE / labeled_sample_count, 6) AS negative_ratio,
             excluded_missing_session_count, excluded_invalid_time_count, excluded_at_or_after_first_purchase_count, session_count, purchase_session_count FROM a, b""",
    "profile_wide": f"{_PROFILE} SELECT * FROM pp",
    "profile_summary": f"{_PROFILE} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c}::DOUBLE AS value FROM pp" for c in _NUMBERS),
    "event_type_distribution": f"{_D} SELECT coalesce(event_type, '<missing>') AS event_type, count(*) AS count, round(count(*)::DOUBLE / (SELECT count(*) FROM dirty), 6) AS ratio FROM dirty GROUP BY 1",
    "missing_values": f'{_MISSING} SELECT column_ AS "column", missing_count, round(missing_count::DOUBLE / rows_, 6) AS missing_ratio FROM mv',
    "quality_issue_draft": f"""{_MISSING}, q AS (
        SELECT 'unexpected_event_type' AS issue, 'warning' AS severity, 'event_type' AS column_, count(*) FILTER (event_type NOT IN ({_ALLOWED})) AS affected_count FROM dirty
        UNION ALL SELECT 'event_time_parse_failure', 'warning', 'event_time', count(*) FILTER (event_time IS NULL) FROM dirty
        UNION ALL SELECT 'missing_values', 'info', column_, missing_count FROM mv)
      SELECT issue, severity, column_ AS "column", affected_count FROM q WHERE affected_count > 0""",
    "quality_row_checks": f"""{_D} SELECT count(*) AS row_count, count(*) FILTER (event_time IS NULL) AS event_time_parse_failures,
        coalesce((SELECT string_agg(t, '|' ORDER BY t) FROM (SELECT DISTINCT event_type AS t FROM dirty WHERE event_type NOT IN ({_ALLOWED}))), '') AS unexpected_event_types,
        count(*) FILTER (price IS NULL) AS price_null_count, count(*) FILTER (price = 0) AS price_zero_count, count(*) FILTER (price < 0) AS price_negative_count,
        round(min(price), 6) AS price_min, round(max(price), 6) AS price_max FROM dirty""",
    "duplicate_rows": f"{_D} SELECT sum(n - 1)::BIGINT AS duplicate_row_count FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(REQUIRED_COLUMNS)})",
    "session_stats": f"{_STATS} SELECT user_session, event_count, purchase_count, round(avg_price, 6) AS avg_price, reversal_count, first_order, round(duration_minutes, 6) AS duration_minutes FROM st",
    "session_comparison": f"""{_STATS} SELECT CASE WHEN purchase_count > 0 THEN 'purchase' ELSE 'non_purchase' END AS segment, count(*) AS session_count, round(avg(event_count), 6) AS avg_event_count,
        round(median(event_count)::DOUBLE, 6) AS median_event_count, round(avg(duration_minutes), 6) AS avg_duration_minutes, round(median(duration_minutes), 6) AS median_duration_minutes,
        round(avg(avg_price), 6) AS avg_price_per_event FROM st GROUP BY 1""",
    "extreme_sessions": f"""{_STATS} SELECT user_session, event_count, purchase_count, round(duration_minutes, 6) AS duration_minutes, reversal_count > 0 AS has_time_reversal
        FROM st WHERE event_count >= 5 ORDER BY event_count DESC, first_order LIMIT 20""",
    "time_reversals": f"{_STATS} SELECT sum(reversal_count)::BIGINT AS reversal_event_count, count(*) FILTER (reversal_count > 0) AS reversal_session_count FROM st",
    "quality_summary": f"""{_STATS}, c AS (
        SELECT 'schema_required_columns' AS check_, 0::BIGINT AS n UNION ALL SELECT 'event_time_parse', count(*) FILTER (event_time IS NULL) FROM dirty
        UNION ALL SELECT 'event_type_allowed_values', count(*) FILTER (event_type NOT IN ({_ALLOWED})) FROM dirty UNION ALL SELECT 'price_positive', count(*) FILTER (price <= 0) FROM dirty
        UNION ALL SELECT 'duplicate_rows', (SELECT sum(k - 1)::BIGINT FROM (SELECT count(*) AS k FROM dirty GROUP BY {', '.join(REQUIRED_COLUMNS)}))
        UNION ALL SELECT 'session_time_order', sum(reversal_count)::BIGINT FROM st UNION ALL SELECT 'extreme_session_length', count(*) FILTER (event_count >= 5) FROM st
        {' '.join(f"UNION ALL SELECT 'missing_{c}', count(*) FILTER ({c} IS NULL) FROM dirty" for c in REQUIRED_COLUMNS)})
      SELECT check_ AS "check", CASE WHEN n = 0 THEN 'pass' ELSE 'review' END AS status, n AS affected_count FROM c""",
    "eda_overview": f"""{_SAMPLES}, a AS (SELECT count(*)::DOUBLE AS s, sum(purchased)::DOUBLE AS p FROM sess), b AS (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS k FROM samples)
      SELECT 'session_count' AS metric, s AS value FROM a UNION ALL SELECT 'purchase_session_count', p FROM a UNION ALL SELECT 'labeled_sample_count', n FROM b
      UNION ALL SELECT 'positive_sample_count', k FROM b UNION ALL SELECT 'negative_sample_count', n - k FROM b UNION ALL SELECT 'positive_sample_ratio', round(k / n, 6) FROM b""",
    "conversion_by_session_length": f"{_BY_LENGTH} SELECT * FROM bl",
    "conversion_by_pattern": f"""{_SAMPLES}, o AS (SELECT user_session, event_type, source_order, row_number() OVER (PARTITION BY user_session ORDER BY source_order) AS i FROM samples WHERE event_type <> 'purchase'),
      x AS (SELECT user_session, string_agg(event_type, ' > ' ORDER BY source_order) AS pat FROM o WHERE i <= 5 GROUP BY 1)
      SELECT coalesce(pat, '<empty>') AS sequence_pattern, count(*) AS session_count, sum(purchased)::BIGINT AS purchase_session_count, round(sum(purchased)::DOUBLE / count(*), 6) AS purchase_rate
      FROM sess LEFT JOIN x USING (user_session) GROUP BY 1 ORDER BY session_count DESC, sequence_pattern LIMIT 20""",
    "conversion_by_price_band": f"""{_SAMPLES}, d AS (SELECT unnest(['(-inf, 25]', '(25, 50]', '(50, 100]', '(100, 250]', '(250, 500]', '(500, 1000]', '(1000, inf)', '<missing>']) AS price_band),
      f AS (SELECT {_BAND} AS price_band, count(*) AS sample_count, sum(label)::BIGINT AS positive_count, round(avg(price) + 1e-9::DOUBLE, 6) AS avg_price FROM samples GROUP BY 1) {_RATE.format(k='price_band')}""",
    "conversion_by_hour": f"""{_SAMPLES}, d AS (SELECT unnest(range(24))::INT AS hour),
      f AS (SELECT hour(event_time)::INT AS hour, count(*) AS sample_count, sum(label)::BIGINT AS positive_count, round(avg(price) + 1e-9::DOUBLE, 6) AS avg_price FROM samples GROUP BY 1) {_RATE.format(k='hour')}""",
    "category_conversion": f"""{_SAMPLES} SELECT {_CATEGORY} AS category, count(*) AS total_events, count(*) FILTER (event_type = 'view') AS view_events, count(*) FILTER (event_type = 'purchase') AS purchase_events,
      round(coalesce(count(*) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (event_type = 'view'), 0), 0), 6) AS purchase_to_view_rate
      FROM t GROUP BY 1 ORDER BY total_events DESC, category LIMIT 20""",
    "sample_comparison": f"""{_SAMPLES} SELECT CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS label_segment, count(*) AS sample_count, round(avg(price) + 1e-9::DOUBLE, 6) AS avg_price,
      {', '.join(f"round(avg((event_type = '{t}')::INT), 6) AS {t}_ratio" for t in EVENT_TYPES)} FROM samples GROUP BY 1""",
    "eda_interpretation": f"""{_BY_LENGTH} SELECT arg_max(session_length_band, purchase_rate) AS best_band, max(purchase_rate) AS best_rate, arg_min(session_length_band, purchase_rate) AS worst_band, min(purchase_rate) AS worst_rate,
      round(max(purchase_rate) - min(purchase_rate), 6) AS spread, round(sum(purchase_session_count)::DOUBLE / sum(session_count), 6) AS overall_rate FROM bl WHERE session_count > 0""",
}
