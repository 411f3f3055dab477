"""Feature, split and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import features as f
from clickloom.operators import sequences as q
from clickloom.policies import FeaturePolicy, SequencePolicy
from clickloom.sources.clickstream import CLICKSTREAM_SQL, clickstream

WINDOW = 360
_POLICY = FeaturePolicy(WINDOW)
_FULL = SequencePolicy()


def _built(spark, sf_dir, by="count"):
    return f.build_features(clickstream(spark, sf_dir), _POLICY, by)


def _by_user(spark, sf_dir):
    """Sessions of about 67 events, so that the sequence length bites."""
    events = clickstream(spark, sf_dir, session_by_user=True)
    return f.eligible(f.prefix_features(events, FeaturePolicy(WINDOW, max_sequence_length=5)))


def _sequences(spark, sf_dir):
    return f.sequence_samples(_built(spark, sf_dir))


def _encoded(spark, sf_dir):
    found = q.encoded_sequences(_sequences(spark, sf_dir), policy=_FULL)
    ids = [c for c in found.columns if c.endswith("_ids")]
    total = F.aggregate("time_gaps", F.lit(0.0), lambda a, g: a + g.cast("double"))
    return found.select("sample_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in ids], F.round(total, 3).alias("gap_sum"), "sequence_length")


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


_MINUTES = ("session_elapsed_minutes", "time_since_previous_event_minutes")

QUERIES = {
    "tabular_features": lambda spark, d: _rounded(f.tabular_features(_built(spark, d)), *_MINUTES),
    "tabular_features_extended": lambda spark, d: _rounded(f.tabular_features(_built(spark, d), extended=True), *_MINUTES, "avg_price", "user_minutes_since_last_event"),
    "sequence_features": lambda spark, d: f.sequence_features(_built(spark, d)),
    "sequence_tail": lambda spark, d: f.sequence_features(_by_user(spark, d)),
    "user_history": lambda spark, d: _rounded(f.user_history(_built(spark, d)), "user_minutes_since_last_event"),
    "sample_index": lambda spark, d: _rounded(f.sample_index(_built(spark, d)), "minutes_until_purchase"),
    "split_by_count": lambda spark, d: _built(spark, d).select("sample_id", "split"),
    "split_by_distinct_time": lambda spark, d: _built(spark, d, "time").select("sample_id", "split"),
    "split_summary": lambda spark, d: f.split_summary(_built(spark, d)),
    "transformer_scope": lambda spark, d: f.transformer_scope(_built(spark, d)),
    "feature_dictionary": lambda spark, d: f.feature_dictionary(spark),
    "training_feature_dictionary": lambda spark, d: f.training_dictionary(f.feature_dictionary(spark)),
    "leakage_checks": lambda spark, d: f.leakage_checks(_built(spark, d)),
    "token_vocabulary": lambda spark, d: q.token_vocabulary(_sequences(spark, d), _FULL),
    "time_gap_scaler": lambda spark, d: _rounded(q.time_gap_scaler(_sequences(spark, d), _FULL), "mean", "std"),
    "encoded_sequences": _encoded,
    "stratified_cap": lambda spark, d: q.stratified_cap(f.sample_index(_built(spark, d)), 101).select("sample_id", "split", "label"),
    "head_per_split": lambda spark, d: q.head_per_split(f.sample_index(_built(spark, d)), 100).select("sample_id", "split"),
    "joined_samples": lambda spark, d: q.join_samples(f.sample_index(_built(spark, d)), f.tabular_features(_built(spark, d))).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("prefix_length").alias("events")),
}

_BAND = """CASE WHEN price IS NULL THEN '<missing>' WHEN price <= 25 THEN '(-inf, 25]' WHEN price <= 50 THEN '(25, 50]' WHEN price <= 100 THEN '(50, 100]'
  WHEN price <= 250 THEN '(100, 250]' WHEN price <= 500 THEN '(250, 500]' WHEN price <= 1000 THEN '(500, 1000]' ELSE '(1000, inf)' END"""
_GAP = "(epoch_us({1}) - epoch_us({0})) / 60000000.0::DOUBLE"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"


def _features(length: int = 50, session: str = "user_session") -> str:
    def joined(column: str) -> str:
        return f"string_agg({column}, ' ') OVER (s ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"

    return f"""WITH {CLICKSTREAM_SQL}, v AS (
  SELECT * REPLACE ({session} AS user_session), {_BAND} AS band, lag(event_time) OVER (PARTITION BY {session} ORDER BY event_time, source_order) AS prev,
         min(CASE WHEN event_type = 'purchase' THEN event_time END) OVER (PARTITION BY {session}) AS fp FROM clickstream
), w AS (SELECT *, printf('%.6f', coalesce({_GAP.format('prev', 'event_time')}, 0)) AS gap FROM v), x AS (
  SELECT *, row_number() OVER s AS prefix_length, {_GAP.format('first_value(event_time) OVER s', 'event_time')} AS session_elapsed_minutes, {_GAP.format('prev', 'event_time')} AS time_since_previous_event_minutes,
    {', '.join(f"sum((event_type = '{t}')::INT) OVER (s ROWS UNBOUNDED PRECEDING)::BIGINT AS event_count_{t}" for t in ('view', 'cart', 'remove_from_cart', 'purchase'))},
    {', '.join(f"count(DISTINCT {c}) OVER (s ROWS UNBOUNDED PRECEDING)::BIGINT AS unique_{n}_count" for n, c in (('product', 'product_id'), ('category', 'category_id'), ('brand', 'brand')))},
    avg(price) OVER (s ROWS UNBOUNDED PRECEDING) AS avg_price, max(price) OVER (s ROWS UNBOUNDED PRECEDING) AS max_price,
    last_value(price IGNORE NULLS) OVER (s ROWS UNBOUNDED PRECEDING) AS last_price,
    {joined('event_type')} AS event_type_sequence, {joined("coalesce(product_id::VARCHAR, '<missing>')")} AS product_id_sequence,
    {joined("coalesce(category_id::VARCHAR, '<missing>')")} AS category_id_sequence, {joined('band')} AS price_bin_sequence, {joined('gap')} AS time_gap_minutes_sequence,
    count(*) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_past_event_count,
    coalesce(sum((event_type = 'purchase')::INT) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS user_past_purchase_count,
    coalesce(sum((event_type = 'cart')::INT) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS user_past_cart_count,
    count(DISTINCT user_session) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_past_session_count,
    {_GAP.format('lag(event_time) OVER u', 'event_time')} AS user_minutes_since_last_event
  FROM w WINDOW s AS (PARTITION BY user_session ORDER BY event_time, source_order), u AS (PARTITION BY user_id ORDER BY event_time, source_order)
), e AS (
  SELECT *, format('sample_{{:012d}}', source_order) AS sample_id, hour(event_time)::INT AS hour, (isodow(event_time) - 1)::INT AS day_of_week, event_type AS last_event_type, band AS last_price_bin,
         coalesce(fp > event_time AND fp <= event_time + INTERVAL {WINDOW} MINUTE, false)::INT AS label,
         CASE WHEN fp > event_time AND fp <= event_time + INTERVAL {WINDOW} MINUTE THEN {_GAP.format('event_time', 'fp')} END AS minutes_until_purchase
  FROM x WHERE fp IS NULL OR event_time < fp
), c AS (
  SELECT event_time, sum(count(*)) OVER (ORDER BY event_time)::BIGINT AS upto, sum(count(*)) OVER ()::BIGINT AS n FROM e GROUP BY 1
), b AS (
  SELECT min(CASE WHEN upto >= floor(n * 0.7::DOUBLE) THEN event_time END) AS t1, min(CASE WHEN upto >= floor(n * 0.85::DOUBLE) THEN event_time END) AS t2 FROM c
), f AS (
  SELECT e.*, CASE WHEN event_time <= t1 THEN 'train' WHEN event_time <= t2 THEN 'validation' ELSE 'test' END AS split FROM e, b
)"""


_F = _features()
_TAB = """sample_id, prefix_length, last_event_type, round(session_elapsed_minutes, 6) AS session_elapsed_minutes, round(time_since_previous_event_minutes, 6) AS time_since_previous_event_minutes, hour,
  event_count_view, event_count_cart, event_count_remove_from_cart, unique_product_count, unique_category_count, last_price, last_price_bin, user_past_event_count, user_past_purchase_count, user_past_cart_count"""
_SEQ = "sample_id, event_type_sequence, product_id_sequence, category_id_sequence, price_bin_sequence, time_gap_minutes_sequence"
_TOKENS = f"""{_F}, k AS (
  SELECT sample_id, split, label, {', '.join(f"string_split({c}, ' ')[-50:] AS {c}" for c in f.SEQUENCES)} FROM f
), tk AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS seq, unnest(list_filter({c}, lambda t: t <> '')) AS token FROM k WHERE split = 'train'" for c in f.SEQUENCES[:4])}
), vc AS (
  SELECT seq AS sequence, token, count(*) AS token_count FROM tk GROUP BY 1, 2
), vr AS (
  SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY CASE WHEN sequence <> 'event_type_sequence' THEN -token_count
      ELSE coalesce(nullif(list_position(['view', 'cart', 'remove_from_cart', 'purchase'], token), 0), 5) END, token) AS r FROM vc
), vb AS (
  SELECT sequence, token, r + 1 AS token_id, token_count FROM vr WHERE sequence NOT IN ('product_id_sequence', 'category_id_sequence') OR r <= 10000
), gs AS (
  SELECT avg(g) AS mean, stddev_pop(g) AS std, count(*) AS token_count FROM (SELECT ln(1 + greatest(unnest(time_gap_minutes_sequence)::DOUBLE, 0)) AS g FROM k WHERE split = 'train')
)"""


def _ids(column: str) -> str:
    tokens = f"list_transform({column}, lambda t: coalesce(m_{column}[t], 1))"
    return f"array_to_string(list_slice(list_concat({tokens}, list_transform(range(50), lambda i: 0)), 1, 50), ' ') AS {column.replace('_sequence', '_ids')}"


_SCOPE = [(c, f"round(avg({c}::DOUBLE), 5)", f"round(stddev_pop({c}::DOUBLE), 5)") for c in f.NUMERIC_INPUTS]

#: Written out by hand: what each column is, in the order of the dictionary.
_DICTIONARY = """SELECT (row_number() OVER () - 1)::INT AS position, * FROM (VALUES
  ('sample_id', 'identifier', 'string', 'key'), ('user_session', 'identifier', 'string', 'key'), ('user_id', 'identifier', 'string', 'audit_only'),
  ('cutoff_time', 'time', 'datetime', 'audit_only'), ('split', 'split', 'string', 'audit_only'), ('label', 'target', 'integer', 'target'),
  ('minutes_until_purchase', 'target_diagnostic', 'float', 'audit_only'), ('prefix_length', 'tabular', 'integer', 'tabular_input'),
  ('last_event_type', 'tabular', 'category', 'tabular_input'), ('session_elapsed_minutes', 'tabular', 'float', 'tabular_input'),
  ('time_since_previous_event_minutes', 'tabular', 'float', 'tabular_input'), ('hour', 'tabular', 'integer', 'tabular_input'),
  ('event_count_view', 'tabular', 'integer', 'tabular_input'), ('event_count_cart', 'tabular', 'integer', 'tabular_input'),
  ('event_count_remove_from_cart', 'tabular', 'integer', 'tabular_input'), ('unique_product_count', 'tabular', 'integer', 'tabular_input'),
  ('unique_category_count', 'tabular', 'integer', 'tabular_input'), ('last_price', 'tabular', 'float', 'tabular_input'),
  ('last_price_bin', 'tabular', 'category', 'tabular_input'), ('user_past_event_count', 'tabular', 'integer', 'tabular_input'),
  ('user_past_purchase_count', 'tabular', 'integer', 'tabular_input'), ('user_past_cart_count', 'tabular', 'integer', 'tabular_input'),
  ('event_type_sequence', 'sequence', 'string_sequence', 'sequence_input'), ('product_id_sequence', 'sequence', 'string_sequence', 'sequence_input'),
  ('category_id_sequence', 'sequence', 'string_sequence', 'sequence_input'), ('price_bin_sequence', 'sequence', 'string_sequence', 'sequence_input'),
  ('time_gap_minutes_sequence', 'sequence', 'string_sequence', 'sequence_input')) t(feature_name, feature_group, dtype, model_role)"""

ORACLE_SQL = {
    "tabular_features": f"{_F} SELECT {_TAB} FROM f",
    "tabular_features_extended": f"""{_F} SELECT {_TAB}, prefix_length AS session_position, day_of_week, event_count_purchase, unique_brand_count, round(avg_price, 6) AS avg_price, max_price,
        user_past_session_count, round(user_minutes_since_last_event, 6) AS user_minutes_since_last_event FROM f""",
    "sequence_features": f"{_F} SELECT {_SEQ} FROM f",
    "sequence_tail": f"{_features(5, 'user_id::VARCHAR')} SELECT {_SEQ} FROM e",
    "user_history": f"""{_F} SELECT sample_id, user_past_event_count, user_past_purchase_count, user_past_cart_count, user_past_session_count,
        round(user_minutes_since_last_event, 6) AS user_minutes_since_last_event FROM f""",
    "sample_index": f"""{_F} SELECT sample_id, user_session, user_id::VARCHAR AS user_id, {_ISO.format('event_time')} AS cutoff_time, split, label, round(minutes_until_purchase, 6) AS minutes_until_purchase FROM f""",
    "split_by_count": f"{_F} SELECT sample_id, split FROM f",
    "split_by_distinct_time": f"""{_F}, d AS (SELECT event_time, row_number() OVER (ORDER BY event_time) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT event_time FROM e)),
        g AS (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS t FROM d), h AS (SELECT *, CASE WHEN n > t THEN greatest(floor(n * 0.85::DOUBLE), t + 1) ELSE t END AS v FROM g)
        SELECT sample_id, CASE WHEN r <= t THEN 'train' WHEN r <= v THEN 'validation' ELSE 'test' END AS split FROM e JOIN h USING (event_time)""",
    "split_summary": f"""{_F}, a AS (SELECT split, count(*) AS n, sum(label)::BIGINT AS p, min(event_time) AS lo, max(event_time) AS hi FROM f GROUP BY 1)
        SELECT s.split, coalesce(n, 0) AS sample_count, coalesce(p, 0) AS positive_count, coalesce(n - p, 0) AS negative_count, round(coalesce(p::DOUBLE / n, 0), 6) AS positive_ratio,
        {_ISO.format('lo')} AS cutoff_time_min, {_ISO.format('hi')} AS cutoff_time_max FROM (SELECT unnest(['train', 'validation', 'test']) AS split) s LEFT JOIN a USING (split)""",
    "transformer_scope": f"""{_F}, t AS (SELECT * FROM f WHERE split = 'train')
        {' UNION ALL '.join(f"SELECT '{c}' AS feature_name, 'categorical_vocab' AS transformer_type, 'train' AS fit_split, (SELECT count(*) FROM t) AS train_observation_count, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT {c} AS x FROM t)) AS vocabulary, NULL::DOUBLE AS mean, NULL::DOUBLE AS std" for c in f.CATEGORICAL_INPUTS)}
        UNION ALL {' UNION ALL '.join(f"SELECT '{c}', 'standard_scaler_stats', 'train', count({c}), NULL, {m}, {s} FROM t" for c, m, s in _SCOPE)}""",
    "feature_dictionary": _DICTIONARY,
    "training_feature_dictionary": f"SELECT * FROM ({_DICTIONARY}) WHERE model_role IN ('tabular_input', 'sequence_input')",
    "leakage_checks": f"""{_F}, n AS (SELECT count(*) FILTER (event_time >= fp) AS violations FROM f)
        SELECT unnest(['raw_user_id_excluded', 'raw_user_session_key_only', 'raw_event_time_excluded', 'prefix_scope', 'user_history_scope', 'transformer_fit_scope', 'common_sample_contract']) AS "check", 'pass' AS status, 0::BIGINT AS violations
        UNION ALL SELECT 'post_purchase_excluded', CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END, violations FROM n""",
    "token_vocabulary": f"{_TOKENS} SELECT * FROM vb",
    "time_gap_scaler": f"{_TOKENS} SELECT round(mean, 6) AS mean, round(std, 6) AS std, token_count FROM gs",
    "encoded_sequences": f"""{_TOKENS} SELECT sample_id, {', '.join(_ids(c) for c in f.SEQUENCES[:4])},
        round(list_sum(list_transform(time_gap_minutes_sequence, lambda t: ((ln(1 + greatest(t::DOUBLE, 0)) - mean) / std)::FLOAT::DOUBLE)), 3) AS gap_sum, len(event_type_sequence)::INT AS sequence_length FROM k, gs, {', '.join(f"(SELECT map_from_entries(list((token, token_id))) AS m_{c} FROM vb WHERE sequence = '{c}')" for c in f.SEQUENCES[:4])}""",
    "stratified_cap": f"""{_F}, r AS (SELECT sample_id, split, label, row_number() OVER (PARTITION BY split, label ORDER BY sample_id) AS i FROM f)
        SELECT sample_id, split, label FROM r WHERE i <= CASE WHEN label = 1 THEN 50 ELSE 51 END""",
    "head_per_split": f"{_F}, r AS (SELECT sample_id, split, row_number() OVER (PARTITION BY split ORDER BY sample_id) AS i FROM f) SELECT sample_id, split FROM r WHERE i <= 100",
    "joined_samples": f"{_F} SELECT split, count(*) AS n, sum(prefix_length)::BIGINT AS events FROM f GROUP BY 1",
}
