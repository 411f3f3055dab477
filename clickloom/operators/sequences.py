"""Vocabularies, gap scaling and fixed-length encoding of sequences, fitted on training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.scalars import non_negative, padded, split_sequence, tail
from clickloom.operators.features import SEQUENCES
from clickloom.policies import EVENT_TYPES, SPLITS, SequencePolicy

TOKEN_COLUMNS = SEQUENCES[:4]
GAP_COLUMN = SEQUENCES[4]
_TOP_K = ("product_id_sequence", "category_id_sequence")


def require_unique(frame: DataFrame, key: str) -> None:
    """Raise if a key repeats; runs an aggregate."""
    if not frame.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} isn't unique")


def join_samples(index: DataFrame, inputs: DataFrame, key: str = "sample_id") -> DataFrame:
    """One-to-one join of samples and their inputs; raises if keys repeat or differ, or a split is unknown."""
    for frame in (index, inputs):
        require_unique(frame, key)
    if not index.select(key).join(inputs.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"samples without inputs: {key} differs")
    if not inputs.select(key).join(index.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"inputs without samples: {key} differs")
    if "split" in index.columns and not index.where(~F.col("split").isin(*SPLITS) | F.col("split").isNull()).isEmpty():
        raise ValueError("unknown split")
    return index.join(inputs, key)


def head_per_split(index: DataFrame, count: int | None) -> DataFrame:
    """The first samples of each split."""
    if count is None:
        return index
    rank = F.row_number().over(Window.partitionBy("split").orderBy("sample_id"))
    return index.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")


def stratified_cap(index: DataFrame, count: int) -> DataFrame:
    """The first samples of each split and label: half of `count` positive, at least one, the rest negative."""
    positive = max(1, count // 2)
    quota = F.when(F.col("label") == 1, positive).otherwise(count - positive)
    rank = F.row_number().over(Window.partitionBy("split", "label").orderBy("sample_id"))
    return index.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank").orderBy("split", "label", "sample_id")


def _tokens(column: str, policy: SequencePolicy) -> Column:
    return tail(split_sequence(F.col(column)), policy.max_sequence_length)


def token_vocabulary(samples: DataFrame, policy: SequencePolicy = SequencePolicy()) -> DataFrame:
    """sequence, token, token_id, token_count of the training samples.

    Ids follow pad and unknown: event types in their canonical order and then by name, others by
    falling count and then by token, products and categories up to the vocabulary size.
    """
    train = samples.where(F.col("split") == "train")

    def named(column: str) -> Column:
        return F.transform(_tokens(column, policy), lambda t: F.struct(F.lit(column).alias("sequence"), t.alias("token")))

    pairs = F.flatten(F.array(*map(named, TOKEN_COLUMNS)))
    counted = train.select(F.explode(pairs).alias("p")).groupBy("p.sequence", "p.token").agg(F.count(F.lit(1)).alias("token_count"))
    canonical = F.coalesce(F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("token")), F.lit(0))
    first = F.when(F.col("sequence") != TOKEN_COLUMNS[0], -F.col("token_count")).when(canonical > 0, canonical).otherwise(len(EVENT_TYPES) + 1)
    rank = F.row_number().over(Window.partitionBy("sequence").orderBy(first, "token"))
    # Apart, so that each task keeps no more than the best of products and categories; types and bands are few.
    best = counted.where(F.col("sequence").isin(*_TOP_K)).withColumn("_rank", rank).where(F.col("_rank") <= policy.vocabulary_top_k)
    numbered = best.unionByName(counted.where(~F.col("sequence").isin(*_TOP_K)).withColumn("_rank", rank))
    return numbered.select("sequence", "token", (F.col("_rank") + policy.unknown_id).alias("token_id"), "token_count")


def time_gap_scaler(samples: DataFrame, policy: SequencePolicy = SequencePolicy()) -> DataFrame:
    """One row: mean and population deviation of log1p of the training gaps; (0, 1) without any."""
    gaps = F.explode(F.transform(_tokens(GAP_COLUMN, policy), lambda t: F.log1p(non_negative(t))))
    fitted = samples.where(F.col("split") == "train").select(gaps.alias("g")).agg(F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"), F.count("g").alias("token_count"))
    std = F.when(F.coalesce("std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("std"))
    return fitted.select(F.coalesce("mean", F.lit(0.0)).alias("mean"), std.alias("std"), "token_count")


def encoded_sequences(samples: DataFrame, vocabulary: DataFrame | None = None, policy: SequencePolicy = SequencePolicy()) -> DataFrame:
    """Padded ids of four sequences, scaled gaps and the length of every sample (sample_id is unique).

    Every token becomes a row, is looked up by a hash join and collected again; a sample's rows are
    in one task, so what is shuffled is one row a sample. The vocabulary is at most
    2 * vocabulary_top_k tokens and the few types and bands, and is broadcast.
    """
    vocabulary = token_vocabulary(samples, policy) if vocabulary is None else vocabulary
    known = vocabulary.select("sequence", "token", F.col("token_id").cast("int").alias("_id"))
    scaler = time_gap_scaler(samples, policy).select("mean", "std")

    def named(column: str) -> Column:
        return F.transform(_tokens(column, policy), lambda t, i: F.struct(F.lit(column).alias("sequence"), i.alias("at"), t.alias("token")))

    rows = samples.select("sample_id", "split", "label", F.explode_outer(F.flatten(F.array(*map(named, SEQUENCES)))).alias("_t"))
    looked_up = (
        rows.select("sample_id", "split", "label", "_t.sequence", "_t.at", "_t.token")
        .join(F.broadcast(known), ["sequence", "token"], "left")
        .crossJoin(F.broadcast(scaler))
    )
    gap = F.when(F.col("sequence") == GAP_COLUMN, (F.log1p(non_negative(F.col("token"))) - F.col("mean")) / F.col("std"))
    cells = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("sequence", "at", F.coalesce("_id", F.lit(policy.unknown_id)).alias("id"), gap.alias("gap"))))
    found = looked_up.groupBy("sample_id").agg(F.first("split").alias("split"), F.first("label").alias("label"), F.array_sort(cells).alias("_cells"))

    def own(column: str) -> Column:
        return F.filter("_cells", lambda c: c["sequence"] == column)

    def ids(column: str) -> Column:
        values = F.transform(own(column), lambda c: c["id"])
        return padded(values, policy.max_sequence_length, F.lit(policy.pad_id)).alias(column.replace("_sequence", "_ids"))

    gaps = padded(F.transform(own(GAP_COLUMN), lambda c: c["gap"]), policy.max_sequence_length, F.lit(0.0))
    return found.select(
        "sample_id", "split", "label", *map(ids, TOKEN_COLUMNS), F.transform(gaps, lambda g: g.cast("float")).alias("time_gaps"), F.size(own(TOKEN_COLUMNS[0])).alias("sequence_length")
    )
