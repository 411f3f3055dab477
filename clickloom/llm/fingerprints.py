"""Document fingerprints by winnowing, with built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A selected k-gram is one long: 31 bits of its hash above 28 bits of its position counted from the end.
POSITION_BITS = 28
_LAST = (1 << POSITION_BITS) - 1
#: Rolling hashes are polynomials of word hashes at RADIX, modulo a prime below 2 ** 31, so products fit a long.
PRIME = (1 << 31) - 1
RADIX = 1_000_003_999


def _spans(size: int) -> list[tuple[int, int]]:
    """How runs of `size` are made of shorter ones: (done, more) pairs, a run of `done` followed by one of `more`."""
    steps, done = [], 1
    for bit in bin(size)[3:]:
        steps.append((done, done))
        done *= 2
        if bit == "1":
            steps.append((done, 1))
            done += 1
    return steps


def with_grams(df: DataFrame, text: str, out: str, k: int, window: int) -> DataFrame:
    """df with the winnowed k-grams of a text column as packed longs in `out`, in text order.

    Words (runs of letters and digits, in lower case) are hashed; the hash of k successive words is
    the rolling (polynomial) hash of their hashes. An array expression has no running state, so the
    recurrence goes over lengths instead of positions: the hash of 2n words follows from those of n
    words here and n words on, at every position at once, and k words take about log2(k) such steps.
    Minima of windows are made of those of half windows in the same way. Of each `window` successive
    k-grams the least hash is selected, the rightmost of equals: the position is packed below the
    hash counted from the end, so the smallest long is both. Any k + window - 1 words that two texts
    share have a selected k-gram in common. A text of fewer than k words is one k-gram, fewer than
    `window` k-grams are one window, and a text without words selects nothing. Each array is a
    column of its own, so it is made once.
    """
    words = rf"split(lower({text}), '[^\\p{{L}}\\p{{N}}]+')"
    df = (
        df.withColumn("_w", F.expr(words))
        .withColumn("_h", F.expr(f"transform(filter(_w, w -> w <> ''), w -> pmod(xxhash64(w), {PRIME}L))"))
        .drop("_w")
        .withColumn("_r", F.col("_h"))
    )
    for done, more in _spans(k):
        following = "_r" if more == done else "_h"
        # Past the end of the text a word counts as 0: only the one k-gram of a text of fewer than k words holds such.
        joined = f"(x * {pow(RADIX, more, PRIME)}L + coalesce(get({following}, i + {done}), 0L)) % {PRIME}L"
        df = df.withColumn("_r", F.expr(f"transform(_r, (x, i) -> {joined})"))
    grams = f"least(size(_h), greatest(1, size(_h) - {k - 1}))"
    pack = f"(shiftleft(x, {POSITION_BITS}) | ({_LAST}L - i))"
    df = df.withColumn("_g", F.expr(f"transform(slice(_r, 1, {grams}), (x, i) -> {pack})")).withColumn("_m", F.col("_g"))
    for done, more in _spans(window):
        following = "_m" if more == done else "_g"
        df = df.withColumn("_m", F.expr(f"transform(_m, (x, i) -> least(x, get({following}, i + {done})))"))
    windows = f"least(size(_g), greatest(1, size(_g) - {window - 1}))"
    return df.withColumn(out, F.expr(f"array_distinct(slice(_m, 1, {windows}))")).drop("_h", "_r", "_g", "_m")


def fingerprint_text(selected: str) -> Column:
    """hash:position pairs of selected k-grams, in text order; empty for none."""
    return F.expr(
        f"array_join(transform({selected}, c -> concat(lower(hex(shiftrightunsigned(c, {POSITION_BITS}))), ':', {_LAST}L - (c & {_LAST}L))), ' ')"
    )


def gram_hashes(selected: str) -> Column:
    """The distinct hashes of selected k-grams."""
    return F.expr(f"array_distinct(transform({selected}, c -> shiftrightunsigned(c, {POSITION_BITS})))")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two sets of hashes; 1 if both are empty."""
    return F.expr(
        f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D ELSE size(array_intersect({a}, {b})) / cast(size(array_union({a}, {b})) AS double) END"
    )


def fingerprint_documents(docs: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """`docs` with a `fingerprint` string column of each whole text."""
    selected = with_grams(docs.withColumn("_text", F.coalesce("text", F.lit(""))), "_text", "_selected", k, window)
    return selected.withColumn("fingerprint", fingerprint_text("_selected")).drop("_text", "_selected")


def _place(bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below doc_id, less one, by binary search; 0 for null."""
    steps = [1 << j for j in range(max(1, math.ceil(math.log2(len(bounds) + 1)) + 1))][::-1]
    fixed = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    return F.expr(
        f"""greatest(0, aggregate(array({", ".join(map(str, steps))}), 0,
              (low, step) -> if(coalesce(get({fixed}, low + step - 1) <= doc_id, false), low + step, low)) - 1)"""
    )


def with_next(docs: DataFrame, rows_per_bucket: int = 256, max_buckets: int = 20_000) -> DataFrame:
    """doc_id, text and, for the row after each in doc_id order, the row itself is put behind it in a bucket.

    Returns rows with _bucket, _wrap and _context: buckets are ranges of doc_id with about equal
    numbers of rows, and each bucket also holds the first row of the next one (the last bucket: the
    first row of all, marked by _wrap) with _context true. So successors are found in a window per
    bucket after one shuffle. Bounds are quantiles, at most max_buckets numbers. Null ids come
    first; rows that repeat an id are in the order of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total, known = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    buckets = min(max_buckets, max(1, math.ceil(total / rows_per_bucket)))
    shares = [i / buckets for i in range(buckets)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * buckets))).first()[0] if known else []
    lowest = rows.agg(F.min("doc_id")).first()[0]
    bounds = sorted({*found, lowest}) if known else []
    last = max(0, len(bounds) - 1)
    first_of_all = F.col("doc_id").isNull() if known < total else F.col("doc_id") == F.lit(lowest)
    place = _place(bounds) if bounds else F.lit(0)
    at_bound = F.expr(f"coalesce(get(array({', '.join(f'{b}L' for b in bounds)}), _place) = doc_id, false)") if bounds else F.lit(False)
    own = F.struct(F.col("_place").alias("bucket"), F.lit(0).alias("wrap"), F.lit(False).alias("context"))
    before = F.struct((F.col("_place") - 1).alias("bucket"), F.lit(0).alias("wrap"), F.lit(True).alias("context"))
    around = F.struct(F.lit(last).alias("bucket"), F.lit(1).alias("wrap"), F.lit(True).alias("context"))
    copies = F.when(first_of_all, F.array(own, around)).when(at_bound & (F.col("_place") > 0), F.array(own, before)).otherwise(F.array(own))
    return (
        rows.withColumn("_place", place)
        .withColumn("_copy", F.explode(copies))
        .select(
            "doc_id",
            "text",
            F.col("_copy.bucket").alias("_bucket"),
            F.col("_copy.wrap").alias("_wrap"),
            F.col("_copy.context").alias("_context"),
        )
    )


def op2_winnowing(docs: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The next document is the next row by (doc_id, text), nulls first, after the last one the first;
    in a table of one row it is that row. An empty table gives an empty result.
    """
    follow = Window.partitionBy("_bucket").orderBy("_wrap", F.col("doc_id").asc_nulls_first(), "text", "_context")
    rows = with_next(docs).withColumn("_next_text", F.lead("text").over(follow))
    rows = with_grams(rows, "text", "_own", k, window).withColumn("_hashes", gram_hashes("_own"))
    rows = rows.withColumn("_next_hashes", F.lead("_hashes").over(follow)).where(~F.col("_context"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn(
        "_edited",
        F.expr("concat(substring(text, 1, cast(n_chars AS int) - _cut), substring(coalesce(_next_text, ''), 1, _cut))"),
    )
    rows = with_grams(rows, "_edited", "_other", k, window).withColumn("_other_hashes", gram_hashes("_other"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint_text("_own").alias("fingerprint"),
        fingerprint_text("_other").alias("edited_fingerprint"),
        likeness("_hashes", "_other_hashes").alias("near_edited"),
        likeness("_hashes", "_next_hashes").alias("near_next"),
    )
