"""Gradient boosting with trees grown leaf by leaf, from histograms of binned features. Fitting runs actions."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gradients are summed as whole multiples of this, so that sums don't depend on the order of rows.
_UNIT = 2.0**-20
#: Columns of stored blocks of rows, and how many rows a task has at most, as far as the input's parts allow.
_STORED = ["key", "label", "bins", "margin"]
_PART_ROWS = 1 << 20


@dataclass(frozen=True)
class LeafwisePolicy:
    """Trees of at most `leaves` leaves over at most `bins` bins a feature; margins are stored every `save_every` trees."""

    trees: int = 200
    leaves: int = 31
    learning_rate: float = 0.05
    bins: int = 255
    subsample: float = 0.8
    column_share: float = 0.8
    min_leaf_rows: int = 20
    min_leaf_hessian: float = 1e-3
    save_every: int = 10
    seed: int = 42


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. Rows with a bin up to the threshold go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: int) -> int:
        """Gives a leaf two children, and returns the left one; the right one follows it."""
        child = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, child
        for _ in range(2):
            self.feature.append(-1), self.threshold.append(0), self.left.append(0), self.value.append(0.0)
        return child

    def nodes(self, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every row, or of those at the places `rows`."""
        feature, threshold, left = map(np.asarray, (self.feature, self.threshold, self.left))
        rows = np.arange(len(bins)) if rows is None else rows
        node = np.zeros(len(rows), np.int64)
        at = np.arange(len(rows))
        while len(at := at[feature[node[at]] >= 0]):
            inner = node[at]
            node[at] = left[inner] + (bins[rows[at], feature[inner]] > threshold[inner])
        return node

    def add_to(self, margin: np.ndarray, bins: np.ndarray) -> None:
        margin += np.asarray(self.value)[self.nodes(bins)]


def gradients(margin: np.ndarray, label: np.ndarray, positive_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss, in whole units."""
    p = 1 / (1 + np.exp(-margin))
    weight = np.where(label == 1, positive_weight, 1.0) / _UNIT
    return np.rint((p - label) * weight), np.rint(p * (1 - p) * weight)


def best_split(hist: np.ndarray, usable: np.ndarray, policy: LeafwisePolicy) -> tuple[float, int, int]:
    """(gain, feature, threshold) from a node's sums (feature, bin, (gradient, hessian, rows)); ties to the first. Gain 0 is none."""
    left = hist.cumsum(axis=1)
    total = left[:, -1:, :]
    right = total - left
    g, h = hist[0, :, 0].sum() * _UNIT, hist[0, :, 1].sum() * _UNIT
    least = policy.min_leaf_hessian / _UNIT
    fits = usable[:, None] & (np.minimum(left[..., 2], right[..., 2]) >= policy.min_leaf_rows) & (np.minimum(left[..., 1], right[..., 1]) >= max(least, 1))
    score = lambda s: np.square(s[..., 0] * _UNIT) / np.maximum(s[..., 1] * _UNIT, _UNIT)
    gain = np.where(fits, score(left) + score(right) - g * g / max(h, _UNIT), 0.0)
    at = int(gain.argmax())
    feature, threshold = divmod(at, hist.shape[1])
    return (float(gain[feature, threshold]), feature, threshold) if gain[feature, threshold] > 1e-9 else (0.0, -1, 0)


def _block(batch: pa.RecordBatch, at: int, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, labels, bins (by row and feature) and margins of a stored block of rows."""
    key, label, bins, margin = (np.frombuffer(batch[c][at].as_py(), kind) for c, kind in (("key", "<i8"), ("label", "u1"), ("bins", "u1"), ("margin", "<f8")))
    return key, label, bins.reshape(features, -1).T, margin


def _sampled(key: np.ndarray, tree: int, policy: LeafwisePolicy) -> np.ndarray:
    """The rows that a tree is grown on, by a hash of row and tree."""
    value = key.view(np.uint64) ^ np.uint64((policy.seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
    return (value ^ (value >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(policy.subsample * 2**53))


def histograms(rows: DataFrame, done: list[Tree], tree: Tree, wanted: list[int], number: int, shape: tuple[int, int], weight: float, policy: LeafwisePolicy) -> np.ndarray:
    """Sums of gradient, hessian and rows by (wanted node, feature, bin): partial sums a task, then one small aggregation.

    Margins are computed for sampled rows of the wanted nodes only.
    """
    features, width = shape
    index = np.full(len(tree.feature), -1)
    index[wanted] = np.arange(len(wanted))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, features, len(wanted) * width), np.int64)
        for batch in batches:
            for block in range(batch.num_rows):
                key, label, bins, margin = _block(batch, block, features)
                at = np.flatnonzero(_sampled(key, number, policy))
                place = index[tree.nodes(bins, at)]
                at, place = at[place >= 0], place[place >= 0]
                own = np.ascontiguousarray(bins.T[:, at])
                reached = margin[at]
                for before in done:
                    before.add_to(reached, own.T)
                sides = (*gradients(reached, label[at], weight), None)
                for f in range(features):
                    cell = place * width + own[f]
                    for i, what in enumerate(sides):
                        sums[i, f] += np.bincount(cell, what, len(wanted) * width).astype(np.int64)
        sums = sums.reshape(3, features, len(wanted), width).transpose(0, 2, 1, 3).reshape(3, -1)
        used = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x[used]) for x in sums)], names=["cell", "g", "h", "n"])

    found = rows.mapInArrow(partial, "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()
    out = np.zeros((len(wanted) * features * width, 3), np.int64)
    for cell, *values in found:
        out[cell] = values
    return out.reshape(len(wanted), features, width, 3)


def _heavier_left(hist: np.ndarray, feature: int, threshold: int) -> int:
    """1 if a split sends more of a node's rows to the left than to the right, else 0."""
    rows = hist[feature, :, 2]
    return int(2 * rows[: threshold + 1].sum() > rows.sum())


def grow(sums, usable: np.ndarray, policy: LeafwisePolicy) -> tuple[Tree, list[int]]:
    """A tree grown best leaf first, and its split features; `sums(tree, nodes)` gives the histograms of some of its leaves.

    The next best leaf needs its children's gains. Those of all leaves that may still be split are
    asked for at once, so a tree takes about as many rounds as it has levels. The child with fewer
    rows is counted, the other one is what remains of its parent.
    """
    ahead = Tree()
    known = {0: sums(ahead, [0])[0]}
    splits = {0: best_split(known[0], usable, policy)}
    while True:
        tree, at, used = Tree(), {0: 0}, []  # at: node of `ahead` to node of `tree`
        heap = [(-splits[0][0], 0)]
        while heap and len(used) < policy.leaves - 1:
            gain, node = heap[0]
            if gain == 0 or ahead.feature[node] < 0:
                break
            heappop(heap)
            child = tree.split(at[node], *splits[node][1:])
            used.append(splits[node][1])
            for i in range(2):
                at[ahead.left[node] + i] = child + i
                heappush(heap, (-splits[ahead.left[node] + i][0], ahead.left[node] + i))
        room = policy.leaves - 1 - len(used)
        ask = [n for gain, n in sorted(heap)[:room] if gain < 0 and ahead.feature[n] < 0]
        if not ask or not room:
            break
        lefts = [ahead.split(n, *splits[n][1:]) for n in ask]
        small = [child + _heavier_left(known[n], *splits[n][1:]) for n, child in zip(ask, lefts)]
        for n, child, one, hist in zip(ask, lefts, small, sums(ahead, small)):
            known[one], known[2 * child + 1 - one] = hist, known[n] - hist
            splits |= {c: best_split(known[c], usable, policy) for c in (child, child + 1)}
    for node, own in at.items():
        g, h = known[node][0, :, :2].sum(axis=0)
        tree.value[own] = float(-policy.learning_rate * g / max(h, 1))
    return tree, used


def _stored(rows: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; only a local master may do without that folder."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return rows.checkpoint()


@dataclass
class Leafwise:
    """A fitted model: the borders of each feature's bins, the first margin, trees, and how often each feature was split."""

    borders: list[list[float]]
    base: float
    trees: list[Tree]
    split_counts: list[int]

    def binned(self, x: Column) -> Column:
        """The bins of an array of features, a byte each: how many borders are below the value."""
        borders = [np.array(b) for b in self.borders]

        @F.pandas_udf("binary")
        def bins_of(values: pd.Series) -> pd.Series:
            table = np.stack(values.to_numpy()) if len(values) else np.empty((0, len(borders)))
            found = np.stack([np.searchsorted(b, table[:, i]) for i, b in enumerate(borders)], axis=1).astype(np.uint8)
            return pd.Series([row.tobytes() for row in found], dtype=object)

        return bins_of(x)

    def score(self, x: Column) -> Column:
        """The probability of label 1."""
        trees, base, features = self.trees, self.base, len(self.borders)

        @F.pandas_udf("double")
        def probability(values: pd.Series) -> pd.Series:
            bins = np.frombuffer(b"".join(values), np.uint8).reshape(-1, features)
            margin = np.full(len(bins), base)
            for tree in trees:
                tree.add_to(margin, bins)
            return pd.Series(1 / (1 + np.exp(-margin)))

        return probability(self.binned(x))


def fit_leafwise(train: DataFrame, balanced: bool = False, policy: LeafwisePolicy = LeafwisePolicy()) -> Leafwise:
    """Fits on sample_id, label (0 or 1) and x (an array of numbers, none null).

    With `balanced` positives weigh as much as negatives in sum. Bins lie between approximate
    quantiles. Only histograms reach the driver: at most leaves * features * bins sums a round. Rows
    are sampled by a hash of their id, so reruns agree. One class only, or no row, is an error.
    """
    first = train.select(F.size("x").alias("n")).first()
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    if first is None or set(counts) != {0, 1}:
        raise ValueError("training samples of both labels are needed")
    shares = [i / policy.bins for i in range(1, policy.bins)]
    cuts = train.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"q{i}") for i in range(first.n)]).first()
    model = Leafwise([sorted(set(q)) for q in cuts], 0.0, [], [0] * first.n)
    weight = counts[0] / counts[1] if balanced else 1.0
    model.base = float(np.log(weight * counts[1] / counts[0]))
    shape = (first.n, max(map(len, model.borders)) + 1)
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-sum(counts.values()) // _PART_ROWS))
    rows = _stored(_blocks(train, model).coalesce(parts))
    for number in range(policy.trees):
        recent = len(model.trees) % policy.save_every
        if number and not recent:
            rows = _stored(_with_margins(rows, model.trees[-policy.save_every :], first.n))
        done = model.trees[len(model.trees) - recent :]
        share = max(1, round(policy.column_share * first.n))
        usable = np.zeros(first.n, bool)
        usable[np.random.default_rng((policy.seed, number)).permutation(first.n)[:share]] = True
        tree, used = grow(lambda t, nodes: histograms(rows, done, t, nodes, number, shape, weight, policy), usable, policy)
        model.trees.append(tree)
        for feature in used:
            model.split_counts[feature] += 1
    return model


def _blocks(train: DataFrame, model: Leafwise) -> DataFrame:
    """The training rows in blocks, a batch of them each, as whole columns: rows cost little to read in every round."""
    borders, base = [np.array(b) for b in model.borders], model.base

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.asarray(batch["x"].flatten()).reshape(-1, len(borders))
            bins = np.stack([np.searchsorted(b, table[:, i]) for i, b in enumerate(borders)]).astype(np.uint8)
            columns = np.asarray(batch["key"]).astype("<i8"), np.asarray(batch["label"]).astype(np.uint8), bins, np.full(batch.num_rows, base, "<f8")
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=_STORED)

    rows = train.select(F.xxhash64("sample_id").alias("key"), F.col("label").cast("int").alias("label"), F.col("x").cast("array<double>").alias("x"))
    return rows.mapInArrow(pack, ", ".join(f"{c} binary" for c in _STORED))


def _with_margins(rows: DataFrame, trees: list[Tree], features: int) -> DataFrame:
    """The rows with the trees added to their margins."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for at in range(batch.num_rows):
                _, _, bins, margin = _block(batch, at, features)
                margin = margin.copy()
                for tree in trees:
                    tree.add_to(margin, bins)
                margins.append(margin.tobytes())
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], batch["bins"], pa.array(margins, pa.binary())], names=_STORED)

    return rows.mapInArrow(add, ", ".join(f"{c} binary" for c in _STORED))
