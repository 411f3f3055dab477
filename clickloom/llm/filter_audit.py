"""How quality filters overlap: what each removes in every order, and its Shapley share, from one polynomial a part."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


class RemovalPolynomial:
    """The rows that filters remove, as a multilinear polynomial in how much of each filter is applied.

    A row that fails the filters of `mask` stays with the product of (1 - x_i) over these, so the
    expected number removed is the sum of counts times one minus that product. It is held by its
    monomials: coefficient T is (-1)^(|T| + 1) times the rows that fail all filters in T.
    """

    def __init__(self, counts: Mapping[int, int], filters: int):
        failing = [sum(n for mask, n in counts.items() if mask & t == t) for t in range(1 << filters)]
        self._coefficients = [0] + [n if t.bit_count() % 2 else -n for t, n in enumerate(failing) if t]
        self.total = failing[0]
        self._corners = list(self._coefficients)
        for bit in range(filters):
            for t in range(1 << filters):
                if t >> bit & 1:
                    self._corners[t] += self._corners[t ^ (1 << bit)]

    def removed(self, applied: int) -> int:
        """The polynomial at the corner where exactly the filters of `applied` (bits) are on: rows removed by them."""
        return self._corners[applied]

    def failing(self, index: int) -> int:
        """Rows that fail filter `index`, whatever else they fail."""
        return self._coefficients[1 << index]

    def shapley(self, index: int) -> Fraction:
        """The integral over the diagonal, t from 0 to 1, of the derivative by filter `index`.

        A monomial T with the filter has the derivative t^(|T| - 1) there, so it gives its coefficient over |T|.
        """
        terms = (Fraction(c, t.bit_count()) for t, c in enumerate(self._coefficients) if t >> index & 1)
        return sum(terms, Fraction(0))


def audit_rows(part: str, letters: str, counts: Mapping[str, Mapping[int, int]]) -> list[tuple]:
    """One row per order of the filters and step of a part. counts: rows by mask of failed filters, of `all`, `good` and `toxic`."""
    every, good, toxic = (RemovalPolynomial(counts[k], len(letters)) for k in ("all", "good", "toxic"))
    orders, full = factorial(len(letters)), (1 << len(letters)) - 1
    share = [int(every.shapley(i) * orders) for i in range(len(letters))]
    unique = [every.removed(full) - every.removed(full ^ (1 << i)) for i in range(len(letters))]
    found = []
    for order in permutations(range(len(letters))):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = every.removed(after) - every.removed(before)
            found.append(
                (
                    part,
                    name,
                    step,
                    every.total - every.removed(after),
                    removed,
                    every.failing(i) - removed,
                    unique[i],
                    good.removed(after) - good.removed(before),
                    toxic.removed(after) - toxic.removed(before),
                    share[i],
                )
            )
            before = after
    return found


def audit_masks(counts: DataFrame, letters: str) -> DataFrame:
    """The audit of every part from counts (part, mask, rows, good, toxic), of any partial sums.

    Parts are independent rows of at most 2^filters masks, so any number of parts is spread over tasks.
    """
    grouped = (
        counts.groupBy("part", "mask")
        .agg(*[F.sum(c).alias(c) for c in ("rows", "good", "toxic")])
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("_masks"))
    )

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in _AUDIT.split(", ")]
        for batch in batches:
            for part, masks in zip(batch["part"], batch["_masks"]):
                by = {k: {int(m["mask"]): int(m[c]) for m in masks} for k, c in (("all", "rows"), ("good", "good"), ("toxic", "toxic"))}
                yield pd.DataFrame(audit_rows(part, letters, by), columns=names)

    return grouped.mapInPandas(audit, _AUDIT)


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few distinct words), C (many capitals), D (a symbol of #$%&*|)."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 100, different * 100 < n * 80, capitals * 100 > F.length(text) * 10, text.rlike(r"[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, rows, good, toxic: documents by language and the filters they fail (bit 0 is A, bit 4 is E).

    E is failed by a text that a row with a smaller doc_id has too. Texts go through one pass and
    are then known by digest; copies are summed before they meet, so a text that a third of all rows
    have is a few rows there. Null texts are empty texts. Rows without doc_id have no smaller one
    and make nobody fail; repeated rows count each, and don't fail for each other. A document with
    several labels is good, or toxic, if one says so; one without id has none. Null lang is the part of
    the empty string.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    failures = [F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(text_failures(text))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        sum(failures[1:], failures[0]).alias("mask"),
    )
    marks = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
    )
    ids = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = ids.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    copies = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("named"), first.alias("first")
    )
    lowest = copies.groupBy("digest").agg(F.min("first.doc_id").alias("lowest"))
    # The rows of the smallest id don't fail; those without id don't either.
    spared = F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(F.lit(0))
    failing = F.col("named") - spared
    split = copies.join(lowest, "digest").select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct((F.col("mask") + 16).alias("mask"), failing.alias("n")),
            F.struct("mask", (F.col("n") - failing).alias("n")),
        )).alias("_of")
    ).where("_of.n > 0")
    n = F.col("_of.n")
    return split.groupBy("part", F.col("_of.mask").alias("mask")).agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
    )


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters A to E and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    An empty table has no parts, so the result is empty.
    """
    return audit_masks(mask_counts(docs, labels), "ABCDE")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), lowest AS (
  SELECT text, min(doc_id) AS lowest FROM d GROUP BY text
), m AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
), f AS (
  SELECT part,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 10 * length(d.text))::INT
         + 8 * regexp_matches(d.text, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > lowest, false)::INT AS mask,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN lowest USING (text) LEFT JOIN m ON d.doc_id = m.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask
), l AS (
  SELECT unnest([0, 1, 2, 3, 4]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x + 1]), '') AS filter_order, step, o[step] AS i,
         coalesce(list_sum(list_transform(o[:step - 1], lambda x: 1 << x)), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, i,
         coalesce(sum(n) FILTER (mask & (before | (1 << i)) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & (1 << i) <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & (1 << i) <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = 1 << i), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & (1 << i) <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & (1 << i) <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, i, before
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM r
"""
