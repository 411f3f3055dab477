"""Product codes of vectors: integer codebooks by Lloyd rounds over kd-trees that drop far entries for whole subtrees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import forget, saved


@dataclass(frozen=True)
class CodePolicy:
    """Shape of the codes and of the trees: rows that a tree spans at most, and points of a leaf at most."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    tree_rows: int = 16_384
    leaf: int = 16


def part_bounds(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end: equal parts, the first ones longer by one if dim isn't a multiple."""
    size, more = divmod(dim, parts)
    return [k * size + min(k, more) for k in range(parts + 1)]


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as longs, held where squared distances of whole vectors still fit a long.

    With 64 components that is from -2^27 on, so only components beyond 130,000 are held.
    """
    most = float(1 << int((61 - math.log2(max(1, vectors.shape[1]))) / 2))
    return np.clip(np.floor(vectors * float(scale)), -most, most).astype(np.int64)


def _exact(points: np.ndarray, entries: np.ndarray) -> type:
    """The type in which products of these are exact: doubles (fast) while sums stay below 2^53, else longs."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    return np.float64 if 16 * most * most * max(1, points.shape[1]) < 1 << 53 else np.int64


class PartTree:
    """A kd-tree over points, kept as an order of the points and, by level, where its nodes begin.

    Every node has its bounding box, the sum and the count of its points. Nodes are halved at the
    median of their box's widest side until they have at most `leaf` points; equal points aren't split.
    """

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        n, self._levels = len(points), [np.array([0, len(points)])]
        while n and (self._levels[-1][1:] - self._levels[-1][:-1]).max() > leaf:
            bounds = self._levels[-1]
            self._levels.append(np.unique(np.concatenate([bounds, (bounds[:-1] + bounds[1:]) // 2])))
        self.order = np.arange(n) if order is None else order
        if order is None:
            for bounds in self._levels[:-1]:
                placed = points[self.order]
                low, high = np.minimum.reduceat(placed, bounds[:-1]), np.maximum.reduceat(placed, bounds[:-1])
                node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                widest = (high - low).argmax(axis=1)
                self.order = self.order[np.lexsort((placed[np.arange(n), widest[node]], node))]
        self.points = points[self.order]
        self._boxes = [
            (np.minimum.reduceat(self.points, b[:-1]), np.maximum.reduceat(self.points, b[:-1])) if n else (points, points) for b in self._levels
        ]
        self._sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])

    def assign(self, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, index of the nearest entry) of runs of points in tree order that cover all points.

        An index is one number for a whole subtree, or one a point of a leaf. From the root down each
        node drops entries: the one nearest to the middle of its box is kept, and every other that no
        point of the box can be nearer to, seen at the corner that lies farthest towards that entry.
        Equally near entries go to the lower index. Nodes of a level are tested together, grouped by
        the entry that they keep, as products of their corners with differences of entries.
        """
        if not len(self.points):
            return
        kind = _exact(self.points, entries)
        e = entries.astype(kind)
        square, index = (e * e).sum(axis=1), np.arange(len(e))
        alive, nodes = np.ones((1, len(e)), bool), np.zeros(1, np.int64)
        for depth, bounds in enumerate(self._levels):
            low, high = (side[nodes].astype(kind) for side in self._boxes[depth])
            middle = low + high
            far = np.where(alive, square - middle @ e.T, np.inf if kind is np.float64 else np.iinfo(np.int64).max)
            nearest = far.argmin(axis=1)
            for z in np.unique(nearest):
                rows = np.flatnonzero(nearest == z)
                apart = e - e[z]
                corner = high[rows] @ np.maximum(apart, 0).T + low[rows] @ np.minimum(apart, 0).T
                behind = (square - square[z]) - 2 * corner
                alive[rows] &= (behind < 0) | (behind == 0) & (index <= z)
            left = alive.sum(axis=1)
            last = depth + 1 == len(self._levels)
            for i in np.flatnonzero(left == 1):
                yield int(bounds[nodes[i]]), int(bounds[nodes[i] + 1]), alive[i].argmax()
            open_ = np.flatnonzero(left > 1)
            if last:
                for i in open_:
                    start, end, some = int(bounds[nodes[i]]), int(bounds[nodes[i] + 1]), np.flatnonzero(alive[i])
                    yield start, end, some[(square[some] - 2 * (self.points[start:end].astype(kind) @ e[some].T)).argmin(axis=1)]
                return
            below = np.searchsorted(self._levels[depth + 1], bounds)
            first, count = below[nodes[open_]], below[nodes[open_] + 1] - below[nodes[open_]]
            alive = np.repeat(alive[open_], count, axis=0)
            nodes = np.concatenate([np.arange(a, a + c) for a, c in zip(first, count)]) if len(open_) else np.empty(0, np.int64)
            if not len(nodes):
                return

    def gathered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points nearest to each entry; those of subtrees are read, not added up again."""
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        for start, end, at in self.assign(entries):
            if np.ndim(at):
                np.add.at(sums, at, self.points[start:end])
                counts += np.bincount(at, minlength=len(entries))
            else:
                sums[at] += self._sums[end] - self._sums[start]
                counts[at] += end - start
        return sums, counts

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of every point, in the points' own order."""
        placed = np.empty(len(self.points), np.int64)
        for start, end, at in self.assign(entries):
            placed[start:end] = at
        own = np.empty_like(placed)
        own[self.order] = placed
        away = np.empty_like(placed)
        away[self.order] = ((self.points - entries[placed]) ** 2).sum(axis=1)
        return own, away


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label, dim of the rows whose vector is not null and has no null or non-finite component.

    Zero and empty vectors stay, and so do rows without id or label and repeated ids.
    """
    good = F.expr("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return chosen.where(good).withColumn("dim", F.size("embedding"))


def _blocks(rows: pa.Table, policy: CodePolicy) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one length of vectors, with the points and tree orders of every part."""
    dims = rows["dim"].to_numpy()
    for dim in np.unique(dims):
        some = rows.filter(pa.array(dims == dim))
        flat = some["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        points = integers(flat.reshape(len(some), dim), policy.scale)
        cut = part_bounds(int(dim), policy.parts)
        orders = [PartTree(points[:, a:b], policy.leaf).order for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(dim)], pa.int32()),
                pa.array([some["vec_id"].to_pylist()], pa.list_(pa.int64())),
                pa.array([some["label"].to_pylist()], pa.list_(some.schema.field("label").type)),
                pa.array([points.astype("<i4").tobytes()], pa.binary()),
                pa.array([[o.astype("<i4").tobytes() for o in orders]], pa.list_(pa.binary())),
            ],
            names=["dim", "vec_ids", "labels", "points", "orders"],
        )


def planted(vectors: DataFrame, policy: CodePolicy) -> DataFrame:
    """The trees of every partition: rows of at most tree_rows vectors, where they are; nothing is moved."""
    label = vectors.schema["label"].dataType.simpleString()

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = policy.tree_rows - sum(b.num_rows for b in waiting)
                waiting.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in waiting) >= policy.tree_rows:
                    yield from _blocks(pa.Table.from_batches(waiting), policy)
                    waiting = []
        if waiting:
            yield from _blocks(pa.Table.from_batches(waiting), policy)

    kind = f"dim int, vec_ids array<long>, labels array<{label}>, points binary, orders array<binary>"
    return vectors.select("vec_id", "embedding", "label", "dim").mapInArrow(plant, kind)


def _trees(block: dict, policy: CodePolicy) -> Iterator[PartTree]:
    """The trees of a block's parts."""
    rows = len(block["vec_ids"])
    points = np.frombuffer(block["points"], "<i4").astype(np.int64).reshape(rows, block["dim"])
    cut = part_bounds(block["dim"], policy.parts)
    for a, b, order in zip(cut, cut[1:], block["orders"]):
        yield PartTree(points[:, a:b], policy.leaf, np.frombuffer(order, "<i4").astype(np.int64))


def first_codebooks(vectors: DataFrame, dim: int, policy: CodePolicy) -> list[np.ndarray]:
    """The parts of the smallest ids' vectors, ascending; ids on several rows by vector, rows without id last."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    chosen = vectors.where(F.col("dim") == dim).orderBy(*order).limit(policy.entries).select("embedding").collect()
    found = integers(np.array([r.embedding for r in chosen], np.float64).reshape(len(chosen), dim), policy.scale)
    cut = part_bounds(dim, policy.parts)
    return [found[:, a:b] for a, b in zip(cut, cut[1:])]


def lloyd_round(trees: DataFrame, books: dict[int, list[np.ndarray]], policy: CodePolicy) -> dict[int, list[np.ndarray]]:
    """Codebooks after one round: entries become the floors of the means of their parts, unused ones stay.

    A task sends one row for each entry it used; the driver gets one row an entry.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block in batch.to_pylist():
                for part, tree in enumerate(_trees(block, policy)):
                    more = tree.gathered(books[block["dim"]][part])
                    have = found.get((block["dim"], part))
                    found[block["dim"], part] = more if have is None else (have[0] + more[0], have[1] + more[1])
        rows = [(dim, p, int(i), s[i].tolist(), int(c[i])) for (dim, p), (s, c) in found.items() for i in np.flatnonzero(c)]
        names = ["dim", "part", "entry", "sums", "count"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    used = trees.select("dim", "vec_ids", "points", "orders").mapInArrow(gather, "dim int, part int, entry int, sums array<long>, count long")
    summed = (
        used.select("dim", "part", "entry", "count", F.posexplode_outer("sums").alias("at", "value"))
        .groupBy("dim", "part", "entry", "at")
        .agg(F.sum("value").alias("value"), F.sum("count").alias("count"))
    )
    renewed = {dim: [book.copy() for book in parts] for dim, parts in books.items()}
    for r in summed.where("at is not null").toLocalIterator():
        renewed[r.dim][r.part][r.entry, r.at] = r.value // r["count"]
    return renewed


def digest_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal integers with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, policy: CodePolicy = CodePolicy()) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """vec_id, label, code (an index per part), error and dim of every kept row, and the codebooks by length of vectors.

    Filtering Lloyd: every partition keeps kd-trees over its parts, in the shared folder; a round goes
    over the trees, not over single points, and moves only sums by entry. Vectors of different lengths
    are different spaces with codebooks of their own; with fewer rows than entries there are as many
    entries as rows. An empty table gives an empty result and no codebooks.
    """
    clean = clean_vectors(vectors)
    trees = saved(planted(clean, policy), "trees")
    dims = sorted(r.dim for r in trees.select("dim").distinct().collect())
    books = {dim: first_codebooks(clean, dim, policy) for dim in dims}
    for _ in range(policy.rounds if dims else 0):
        books = lloyd_round(trees, books, policy)
    label = vectors.schema["label"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.schema.field("labels").type.value_type
            for block in batch.to_pylist():
                found = [tree.nearest(books[block["dim"]][part]) for part, tree in enumerate(_trees(block, policy))]
                codes = np.stack([c for c, _ in found], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["vec_ids"], pa.int64()),
                        pa.array(block["labels"], labels),
                        pa.array(codes.tolist(), pa.list_(pa.int32())),
                        pa.array(sum(d for _, d in found), pa.int64()),
                        pa.array([block["dim"]] * len(codes), pa.int32()),
                    ],
                    names=["vec_id", "label", "code", "error", "dim"],
                )

    coded = saved(trees.mapInArrow(encode, f"vec_id long, label {label}, code array<int>, error long, dim int"), "codes")
    forget(trees)
    return coded, books


def op11_vector_codes(vectors: DataFrame, policy: CodePolicy = CodePolicy()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of `embeddings`.

    Labels are summed before they meet the rows again; that join can be split where a label is
    frequent. A sum beyond a long is null.
    """
    coded, books = encode_vectors(vectors, policy)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    digest = F.lit(None).cast("string")
    for dim, parts in books.items():
        digest = F.when(F.col("dim") == dim, digest_of(parts)).otherwise(digest)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id",
        F.lower(F.concat_ws("", F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")))).alias("code"),
        "error",
        "label_error",
        digest.alias("codebooks_sha256"),
    )


def _oracle(rounds: int) -> str:
    """The same by brute force; one pair of tables a round."""
    nearest = """
n{k} AS MATERIALIZED (
  SELECT p.vec_id, p.part, min({{'d': s + c.square - 2 * list_inner_product(p.v, c.v), 'entry': c.entry}}) AS best
  FROM points p JOIN book{k} c ON p.part = c.part GROUP BY p.vec_id, p.part
)"""
    renew = """
u{k} AS (
  SELECT n.part, n.best.entry AS entry, j, sum(p.v[j])::BIGINT AS total, count(*) AS n
  FROM n{k} n JOIN points p ON n.vec_id = p.vec_id AND n.part = p.part, (SELECT unnest(range(1, 17)) AS j)
  GROUP BY ALL
), m{k} AS (
  SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::DOUBLE ORDER BY j) AS v FROM u{k} GROUP BY part, entry
), book{next} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v, list_inner_product(coalesce(m.v, b.v), coalesce(m.v, b.v)) AS square
  FROM book{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry
)"""
    steps = []
    for k in range(rounds):
        steps += [nearest.format(k=k), renew.format(k=k, next=k + 1)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), points AS MATERIALIZED (
  SELECT vec_id, part, q[16 * part + 1 : 16 * part + 16] AS v,
         list_inner_product(q[16 * part + 1 : 16 * part + 16], q[16 * part + 1 : 16 * part + 16]) AS s
  FROM kept, (SELECT unnest([0, 1, 2, 3]) AS part)
), book0 AS MATERIALIZED (
  SELECT part, entry, v, s AS square
  FROM points JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 256
), {",".join(steps)}, {nearest.format(k=rounds)}, sha AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, 17)) AS j FROM book{rounds})
), coded AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM n{rounds} n JOIN kept k USING (vec_id) GROUP BY k.vec_id, k.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, sha
"""


ORACLE = _oracle(4)
