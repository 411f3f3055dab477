"""Approximate nearest neighbours by query-aware collision counting on sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import saved

_FOUND = "query_id long, vec_id long, _row long, score double"


@dataclass(frozen=True)
class NeighbourPolicy:
    """Shape of the index and of the search.

    Vectors are dealt into blocks of about block_rows. Level 0 windows reach `start` times the largest
    norm on either side and each level is wider by `widen`. A vector in at least `threshold` of the
    windows is verified; a query stops at the lowest level at which that are verify_share of the
    block, and at least verify_least, or all that there are.
    """

    k: int = 20
    projections: int = 224
    threshold: float = 0.86
    start: float = 0.4
    widen: float = 1.04
    verify_share: float = 0.03
    verify_least: int = 200
    block_rows: int = 32_768
    seed: int = 5


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and dim of the rows that take part.

    Left out: null, empty and zero vectors and those with null or non-finite components. Repeated
    ids and rows stay, and so do rows without an id.
    """
    good = F.expr(
        "embedding is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0)"
        " and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    )
    chosen = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(good)
    return chosen.withColumn("dim", F.size("embedding"))


class BlockIndex:
    """One sorted array of projections per hash function over a block of vectors.

    Largest inner product becomes nearest distance by one more component that lifts every vector to
    the same norm; queries have 0 there. Projections of that component are part of the hash
    functions, so lengths other than 1 are handled.
    """

    def __init__(self, vectors: np.ndarray, policy: NeighbourPolicy):
        self._policy = policy
        norms = np.einsum("ij,ij->i", vectors, vectors)
        lifted = np.sqrt(np.maximum(norms.max() - norms, 0))
        self._norm = math.sqrt(norms.max())
        draw = np.random.default_rng(policy.seed).standard_normal((vectors.shape[1] + 1, policy.projections))
        self._axes = draw[:-1]
        values = vectors @ self._axes + lifted[:, None] * draw[-1]
        self._order = np.empty((policy.projections, len(vectors)), np.int64)
        self._values = np.empty((policy.projections, len(vectors)))
        for j in range(policy.projections):
            self._order[j] = np.argsort(values[:, j], kind="stable")
            self._values[j] = values[self._order[j], j]
        self._wanted = min(len(vectors), max(policy.verify_least, math.ceil(policy.verify_share * len(vectors))))
        self._needed = math.ceil(policy.threshold * policy.projections)
        self._begin = 0
        trial = [self._level(vectors[i]) for i in range(0, len(vectors), max(1, len(vectors) // 8))]
        self._begin = int(np.median(trial))

    def _borders(self, centre: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The first position inside and the first beyond the window of each sorted array."""
        radius = self._policy.start * self._norm * self._policy.widen**level
        low = [v.searchsorted(c - radius, "left") for v, c in zip(self._values, centre)]
        high = [v.searchsorted(c + radius, "right") for v, c in zip(self._values, centre)]
        return np.array(low), np.array(high)

    def _count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many of the ranges [low, high) of the sorted arrays each vector is in."""
        parts = [self._order[j, a:b] for j, (a, b) in enumerate(zip(low, high)) if a < b]
        n = self._order.shape[1]
        return np.bincount(np.concatenate(parts), minlength=n) if parts else np.zeros(n, np.int64)

    def _level(self, query: np.ndarray, found: list | None = None) -> int:
        """The lowest level at which enough vectors collide often enough; these go into `found`.

        The search begins at the block's usual level, counting from whichever side of the borders
        has fewer vectors. Each further level counts only those that enter or leave the windows.
        """
        n, m = self._order.shape[1], len(self._order)
        centre = (query @ self._axes) * (self._norm / math.sqrt(float(query @ query)))
        level, start, end = self._begin, np.zeros(m, np.int64), np.full(m, n)
        low, high = self._borders(centre, level)
        if (high - low).sum() * 2 > m * n:
            count = m - self._count(start, low) - self._count(high, end)
        else:
            count = self._count(low, high)
        enough = np.count_nonzero(count >= self._needed) >= self._wanted
        while enough and level > 0:
            inner_low, inner_high = self._borders(centre, level - 1)
            fewer = count - self._count(low, np.minimum(inner_low, high)) - self._count(np.maximum(inner_high, inner_low), high)
            if np.count_nonzero(fewer >= self._needed) < self._wanted:
                break
            level, low, high, count = level - 1, inner_low, inner_high, fewer
        while not enough and ((low > 0).any() or (high < n).any()):
            level += 1
            outer_low, outer_high = self._borders(centre, level)
            count = count + self._count(outer_low, low) + self._count(high, outer_high)
            low, high = outer_low, outer_high
            enough = np.count_nonzero(count >= self._needed) >= self._wanted
        if found is not None:
            found.append(np.flatnonzero(count >= self._needed))
        return level

    def search(self, query: np.ndarray) -> np.ndarray:
        """Positions of the vectors that collide often enough with the query, to be verified."""
        found: list[np.ndarray] = []
        self._level(query, found)
        return found[0]


def _top(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, candidates: np.ndarray, k: int):
    """Positions and inner products of the k best candidates, ties to smaller ids."""
    scores = np.einsum("ij,j->i", vectors[candidates], query)
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        candidates, scores = candidates[scores >= least], scores[scores >= least]
    best = np.lexsort((ids[candidates], -scores))[:k]
    return candidates[best], scores[best]


class _Block:
    """The vectors of a block as they arrive, then their index, made when the first query arrives."""

    def __init__(self, key: tuple[int, int], policy: NeighbourPolicy):
        self.key, self._policy, self._parts, self._index = key, policy, [], None

    def add(self, rows: pd.DataFrame) -> None:
        self._parts.append(rows)

    def answer(self, asks: pd.DataFrame) -> pd.DataFrame:
        if self._index is None and self._parts:
            base = pd.concat(self._parts).sort_values("_row", ignore_index=True)
            self._ids = base["vec_id"].to_numpy(dtype=np.float64, na_value=np.inf)  # for ties only
            self._base, self._vectors = base[["vec_id", "_row"]], np.stack(base["embedding"].to_numpy()).astype(np.float64)
            self._parts, self._index = [], BlockIndex(self._vectors, self._policy)
        out = []
        for query_id, row, query in zip(asks["vec_id"], asks["_row"], asks["embedding"]) if self._index else ():
            query = np.asarray(query, np.float64)
            found = self._index.search(query)
            found = found[self._base["_row"].to_numpy()[found] != row]
            at, scores = _top(query, self._ids, self._vectors, found, self._policy.k)
            out.append(self._base.iloc[at].assign(query_id=query_id, score=scores))
        none = pd.DataFrame({"query_id": [], "vec_id": [], "_row": [], "score": []})
        return pd.concat(out)[list(none.columns)] if out else none


def nearest(vectors: DataFrame, query_every: int = 20, policy: NeighbourPolicy = NeighbourPolicy()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors found of every query_every-th id.

    Every row that clean_vectors leaves is a candidate but the query's own row. An id with several
    rows asks once, with its least vector in array order; its other rows are candidates. Rows
    without id are candidates, after others of the same score. Vectors of different dimensions never
    meet. An empty table has no neighbours.

    A vector is moved once, to its block, where a task sorts the block's projections once and lets
    the queries pass by, a batch at a time; so a task holds one block and a batch of queries. All
    queries go to all blocks, which return k rows each, and these are merged.
    """
    clean = saved(clean_vectors(vectors).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, math.ceil(clean.count() / policy.block_rows))
    rows = clean.withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(policy.seed)), F.lit(blocks)).cast("int")).withColumn("_asks", F.lit(False))
    asks = (
        clean.where(F.pmod(F.col("vec_id"), F.lit(query_every)) == 0)
        .groupBy("vec_id")
        .agg(F.min(F.struct("embedding", "dim", "_row")).alias("_least"))
        .select("vec_id", "_least.embedding", "_least.dim", "_least._row")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("_asks", F.lit(True))
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None
        for batch in batches:
            batch = batch.astype({"vec_id": "Int64"})
            for (dim, number, asking), part in batch.groupby(["dim", "_block", "_asks"], sort=True):
                if block is None or block.key != (dim, number):
                    block = _Block((dim, number), policy)
                if asking:
                    yield block.answer(part)
                else:
                    block.add(part)

    found = (
        rows.unionByName(asks)
        .repartition(blocks, "dim", "_block")
        .sortWithinPartitions("dim", "_block", "_asks")
        .mapInPandas(meet, _FOUND)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "_row")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= policy.k).select("query_id", "rank", "vec_id", "score")
    )


def op5_neighbours(vectors: DataFrame) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return nearest(vectors)
