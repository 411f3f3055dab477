"""Mix sources to target weights by capped water-filling, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import saved

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2
) -> DataFrame:
    """Target size of each source.

    `sizes` has _mix_source (null allowed) and _mix_size rows. Sources in code point order, null
    last, take `weights` in turn and share `share` times the whole size. A source is clamped at
    `max_epochs` times its own size and what it can't take is dealt again by weight until none is
    above. Filling by weight clamps sources in ascending order of cap / weight, so the fixed point
    is read off running sums over that order instead of an iteration: the water level after
    clamping the first i sources is (budget - their caps) / (weights of the rest). It rises with i
    while the next source has to be clamped and falls from the first that hasn't, so its maximum is
    the final level.

    The frame has one row per source; the windows without a partition key run over those rows only.
    Sources without words get target 0. An empty input gives an empty frame.
    """
    per_source = sizes.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size"))
    in_order = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weighted = (
        per_source.withColumn("_mix_weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("_mix_cap", F.col("source_size") * max_epochs)
        .withColumn("_mix_budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    )
    rising = Window.orderBy(F.col("_mix_cap") / F.col("_mix_weight"), F.col("_mix_source").asc_nulls_last())
    caps_before = F.coalesce(F.sum("_mix_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights_left = F.sum("_mix_weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("_mix_budget") - caps_before) / weights_left
    levelled = weighted.withColumn("_mix_level", level)
    water = F.max("_mix_level").over(Window.partitionBy())
    target = F.least(F.col("_mix_cap").cast("double"), water * F.col("_mix_weight"))
    return levelled.select("_mix_source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 17,
    split_boundary: bool = True,
    buckets: int = 4096,
) -> DataFrame:
    """The rows of `docs` (doc_id, text, source and any other columns) with what a mix takes of each.

    Adds _mix_size, source_size, target, _mix_copies (whole repetitions) and _mix_part (words of one
    more, fractional repetition); columns of `docs` named like that get the prefix _mix_own_. Every document of a source is repeated floor(target / source size)
    times; the rest of the target is taken in a seeded order (md5 of seed and doc_id) until it is
    used up. With split_boundary the document at the boundary is taken in part, so the words taken
    sum to the rounded target; otherwise it is taken whole if at least half of it is wanted.

    The order within a source is a two-level running sum: documents of one of `buckets` leading
    digits of the hash, then the buckets' sums; a source that holds most rows is thus spread over
    `buckets` tasks. The texts are read twice: once for the sums per range, a stored table of at most
    `buckets` rows a source, and once for the rows. Null text has size 0; null sources form one source; repeated rows and equal
    hashes are ordered by doc_id and size and are interchangeable.
    """
    sized = docs.withColumn("_mix_size", word_count(F.col("text"))).withColumn("_mix_source", F.col("source"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    digits = max(1, len(f"{buckets - 1:x}"))
    keyed = (
        sized.withColumn("_mix_null", F.col("_mix_source").isNull())
        .withColumn("_mix_name", F.coalesce(F.col("_mix_source"), F.lit("")))
        .withColumn("_mix_key", key)
        .withColumn("_mix_bucket", F.substring("_mix_key", 1, digits))
    )
    group = ["_mix_null", "_mix_name"]
    sums = saved(keyed.groupBy(*group, "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_sum")), "mix-sums")
    per_source = sums.select(F.when(~F.col("_mix_null"), F.col("_mix_name")).alias("_mix_source"), F.col("_mix_sum").alias("_mix_size"))
    targets = source_targets(per_source, weights, share, max_epochs)
    ahead = Window.partitionBy(*group).orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("_mix_ahead", F.coalesce(F.sum("_mix_sum").over(ahead), F.lit(0)))
        .drop("_mix_sum")
        .join(
            targets.select(
                F.col("_mix_source").isNull().alias("_mix_null"),
                F.coalesce("_mix_source", F.lit("")).alias("_mix_name"),
                "source_size",
                "target",
            ),
            group,
        )
    )
    within = (
        Window.partitionBy(*group, "_mix_bucket")
        .orderBy("_mix_key", "doc_id", "_mix_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    clash = {c: f"_mix_own_{c}" for c in ("source_size", "target") if c in docs.columns}
    ranked = keyed.withColumnsRenamed(clash).withColumn("_mix_before", F.coalesce(F.sum("_mix_size").over(within), F.lit(0)))
    joined = ranked.join(offsets, [*group, "_mix_bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    wanted = F.round("target").cast("long") - F.col("_mix_copies") * F.col("source_size")
    left = F.col("_mix_wanted") - F.col("_mix_ahead") - F.col("_mix_before")
    if split_boundary:
        part = F.greatest(F.lit(0), F.least(F.col("_mix_size"), left))
    else:
        part = F.when(F.col("_mix_size") <= 2 * left, F.col("_mix_size")).otherwise(F.lit(0))
    return (
        joined.withColumn("_mix_copies", whole)
        .withColumn("_mix_wanted", wanted)
        .withColumn("_mix_part", part.cast("long"))
        .drop("_mix_null", "_mix_name", "_mix_key", "_mix_bucket", "_mix_before", "_mix_ahead", "_mix_wanted", "_mix_source")
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of `docs`, each row as often as the mix takes the document.

    Whole documents only: the one at a source's boundary goes in if at least half of it is wanted.
    """
    mixed = mix_sources(docs, split_boundary=False, **options)
    times = F.col("_mix_copies") + F.when(F.col("_mix_part") > 0, 1).otherwise(0)
    repeated = mixed.withColumn("_mix_times", times).where("_mix_times > 0")
    return repeated.withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(
        *[F.col(f"_mix_own_{c}" if f"_mix_own_{c}" in mixed.columns else c).alias(c) for c in docs.columns]
    )


def op8_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies, part_words."""
    mixed = mix_sources(docs.select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        "source_size",
        "target",
        (F.col("_mix_copies") * F.col("_mix_size") + F.col("_mix_part")).cast("long").alias("taken"),
        F.col("_mix_copies").alias("copies"),
        F.col("_mix_part").alias("part_words"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::INT AS weight,
         source_size * 2 AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS budget
  FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM w WINDOW r AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, max(level) OVER () * weight) AS target
  FROM l
), j AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::INT AS copies,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, greatest(0, least(size, round(target)::BIGINT - copies * source_size - before))::BIGINT AS part_words FROM j
)
SELECT doc_id, size, source_size, target, (copies * size + part_words)::BIGINT AS taken, copies, part_words FROM p
"""
