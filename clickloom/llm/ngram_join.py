"""Documents joined by n-gram Jaccard: products of document by n-gram incidence, in blocks of columns and of rows."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import forget, saved
from clickloom.llm.near_dedup import _BASE, _BASE_INVERSE, _mix, _powers, components

_STEP = np.uint64(0x2545F4914F6CDD1D)
_GROUP = np.uint64(0x9E3779B97F4A7C15)
#: Nodes that a task remembers, so that copies in it send their keys once.
_REMEMBERED = 1 << 20


@dataclass(frozen=True)
class JoinPolicy:
    """Sets of `words`-word shingles; links from percent / 100 of the union on.

    Sizes are dealt into classes, each `widen` times as wide as the one before. Blocks of rows have at
    most block_rows documents and about block_entries incidences. Keys that at least hot_rows rows
    have (more, so that there are at most hot_keys of them) are grouped apart.
    """

    words: int = 4
    percent: int = 85
    widen: float = 1.5
    spare_odds: float = 1e-4
    block_rows: int = 512
    block_entries: int = 1_000_000
    hot_rows: int = 4096
    hot_keys: int = 50_000
    hot_sample: int = 16


def least_overlap(percent: int, n: int, m: np.ndarray) -> np.ndarray:
    """The smallest intersection with which sets of n and m members link: i >= percent / 100 * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; the whole sequence if it has fewer words, nothing without words.

    Words are what stands between ASCII white space; only A-Z are lower-cased.
    """
    if not text:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    lowered = codes + np.where((codes >= 65) & (codes <= 90), np.uint32(32), np.uint32(0))
    bits = max(16, int(len(codes)).bit_length())
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, bits)[: len(codes)], out=sums[1:])
    word = _mix((sums[end] - sums[start]) * _powers(_BASE_INVERSE, bits)[start])
    k = min(words, len(word))
    value = np.full(len(word) - k + 1, k, np.uint64)
    for j in range(k):
        value = value * _STEP + word[j : j + len(value)]
    return np.unique(_mix(value))


def node_of(grams: np.ndarray) -> int:
    """One signed long for a set of shingles; two of N sets have the same with a chance of N * N / 2^65."""
    return int(_mix(np.array([_mix(grams + _GROUP).sum() + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def _few_filled(members: int, blocks: int, most: int) -> float:
    """The chance that so many members leave all but at most `most` of so many blocks empty; by a normal curve beyond 400 members."""
    if members > 400:
        empty = blocks * (1 - 1 / blocks) ** members
        spread = blocks * (blocks - 1) * (1 - 2 / blocks) ** members + empty - empty * empty
        return 0.5 * math.erfc((blocks - empty - most - 0.5) / math.sqrt(2 * max(spread, 1e-9)))
    filled = np.zeros(most + 1)
    filled[0] = 1.0
    again = np.arange(most + 1) / blocks
    for _ in range(members):
        filled = filled * again + np.concatenate([[0.0], filled[:-1] * (1 - again[:-1])])
    return float(filled.sum())


def _spare(least: int, differing: int, odds: float) -> int:
    """How many blocks more are needed so that a set of `least` members fills at most `differing` blocks only with `odds`."""
    enough = lambda spare: _few_filled(least, differing + 1 + spare, differing) < odds
    high = 1
    while not enough(high) and high < 64 * least:
        high *= 2
    return bisect_left(range(high), True, key=enough)


@cache
def _class(at: int, policy: JoinPolicy) -> tuple[int, int]:
    """The sizes from first to last of class `at`. Smaller sets than class 0's link to equal ones only."""
    first = -(-policy.percent // (100 - policy.percent))
    for _ in range(at):
        first = max(first + 1, int(first * policy.widen))
    return first, max(first + 1, int(first * policy.widen)) - 1


def _differing(total: int, policy: JoinPolicy) -> int:
    """The most members that are in one only of two linked sets with sizes summing to `total`."""
    return total * (100 - policy.percent) // (100 + policy.percent)


@cache
def _layout(low: int, total: int, policy: JoinPolicy) -> int:
    """Column blocks, spare ones included, for sets of `low` members at least that link with sizes summing to `total` at most."""
    differing = _differing(total, policy)
    return differing + 1 + _spare(low, differing, policy.spare_odds)


def column_layouts(n: int, policy: JoinPolicy) -> list[tuple[int, int, int]]:
    """(id, column blocks, blocks in which linked sets may differ from it) of the layouts in which a set of n members takes part.

    One for its class of sizes, and one for each border of classes that a linked set may lie beyond:
    sizes of linked sets differ by at most the factor percent / 100.
    """
    at = 0
    if n < _class(0, policy)[0]:
        return []
    while _class(at, policy)[1] < n:
        at += 1
    first, last = _class(at, policy)
    widest = n * 100 // policy.percent
    found = [(2 * at, _layout(first, 2 * last, policy), _differing(n + min(last, widest), policy))]
    for border, beyond in ((at, first), (at + 1, last + 1)):
        low, high = -(-policy.percent * beyond // 100), (beyond - 1) * 100 // policy.percent
        if border and low <= n <= high:
            found.append((2 * border + 1, _layout(low, beyond - 1 + high, policy), _differing(n + (widest if n < beyond else beyond - 1), policy)))
    return found


def block_keys(grams: np.ndarray, policy: JoinPolicy) -> np.ndarray:
    """A key for the content of each column block of a set of shingles.

    Linked sets of n and m members differ in at most (n + m) * (100 - percent) / (100 + percent)
    shingles. Columns are dealt into more blocks than that, so linked sets agree in all of some block,
    even in one that isn't empty if the set fills more blocks than linked ones may differ in; only sets
    that don't have keys for empty blocks too. The others have keys for their last filled blocks, one
    more than may differ: of those in which two sets agree, one is among the last of both, as the longer
    of the first parts left out holds fewer filled blocks than agree. So no link is lost, and sets that
    share a frequent shingle or passage only have no key in common.
    """
    found = [np.empty(0, np.uint64)]
    mixed = _mix(grams + _GROUP)
    for layout, blocks, differing in column_layouts(len(grams), policy):
        block = ((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        content, at = np.add.reduceat(mixed, start), block[start]
        if len(start) > differing:
            content, at = content[-differing - 1 :], at[-differing - 1 :]
        else:
            gaps = np.setdiff1d(np.arange(blocks, dtype=np.uint64), at, assume_unique=True)
            content, at = np.concatenate([content, np.zeros(len(gaps), np.uint64)]), np.concatenate([at, gaps])
        found.append(_mix(content + _mix(at + np.array([layout], np.uint64) * _GROUP)))
    return np.concatenate(found).view(np.int64)


def sketch_sets(docs: DataFrame, policy: JoinPolicy) -> DataFrame:
    """doc_id, node, size and keys of every row; one pass, nothing is moved. Rows without words have no node.

    Of equal sets in a task only the first has keys.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch["text"].to_pylist():
                grams = shingles(text, policy.words)
                node = node_of(grams) if len(grams) else None
                nodes.append(node)
                sizes.append(len(grams))
                keys.append(np.empty(0, np.int64) if node in seen or node is None else block_keys(grams, policy))
                seen.add(node)
            if len(seen) > _REMEMBERED:
                seen.clear()
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *keys]), pa.int64())),
                ],
                names=["doc_id", "node", "size", "keys"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(sketch, "doc_id long, node long, size long, keys array<long>")


def meetings(sketches: DataFrame, policy: JoinPolicy) -> DataFrame:
    """key, node, rep: the sets that have a key in common with others, with the least node of the key; rep itself left out.

    Keys that the same sets have are one, named by a hash of these sets: copies agree in very many blocks.
    Keys go through one shuffle. Those that very many rows have are found on a share of the nodes
    (that decides where they are grouped, not what comes out) and pre-aggregated instead.
    """
    keys = sketches.select("node", F.explode("keys").alias("key"))
    share = sketches.where(F.pmod(F.xxhash64("node"), F.lit(policy.hot_sample)) == 0).select(F.explode("keys").alias("key"))
    total = sketches.agg(F.sum(F.size("keys"))).first()[0] or 0
    least = max(policy.hot_rows, math.ceil(total / policy.hot_keys)) / policy.hot_sample
    hot = saved(share.groupBy("key").count().where(F.col("count") >= least).select("key"), "hot")
    placed = keys.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "key", "left")
    window = Window.partitionBy("key")
    mark = F.xxhash64("node")
    sums = [F.count(mark), F.sum(F.shiftright(mark, 32)), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF)))]
    usual = (
        placed.where("_hot is null")
        .select("key", "node", F.min("node").over(window).alias("rep"), F.max("node").over(window).alias("_other"))
        .where("rep <> _other")
        .select("node", "rep", F.xxhash64("rep", *(x.over(window) for x in sums)).alias("key"))
    )
    if hot.isEmpty():
        found = usual
    else:
        rows = placed.where("_hot").select("key", "node")
        reps = rows.groupBy("key").agg(F.min("node").alias("rep"), F.xxhash64(F.min("node"), *sums).alias("_sets"))
        found = usual.unionByName(rows.join(F.broadcast(reps), "key").select("node", "rep", F.col("_sets").alias("key")))
    return found.where("node <> rep").select("key", "node", "rep").distinct()


def _among(rows: DataFrame, column: str, few: DataFrame) -> DataFrame:
    """The rows whose `column` may be in `few` (a stored table of that one column): a broadcast bitmap of hashes, 16 bits a value and 16 MB at most.

    An exact join follows; this only spares it the shuffle of wide rows that have no match.
    """
    bits = min(1 << 27, 1 << max(15, (16 * few.count() - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    made = few.select(place(few.columns[0]).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_p", place(column)).withColumn("_bucket", F.bitmap_bucket_number("_p")).join(F.broadcast(made), "_bucket")
    return found.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).select(*rows.columns)


def least_ids(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and _id, the least id of its rows, of the given nodes."""
    return rows.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("_id"))


def sets_of(docs: DataFrame, ids: DataFrame, policy: JoinPolicy, whole: bool) -> DataFrame:
    """node, size and the set of each node of `ids` (a stored table of least_ids): whole ones as grams, else folded.

    Texts are read where they are stored, those of other ids left out by a bitmap, and only sets are
    moved. Rows of repeated ids, and of none, are told apart by their node.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    name, kind = ("grams", "array<long>") if whole else ("folded", "binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [g for g in (shingles(t, policy.words) for t in batch["text"].to_pylist()) if len(g)]
            sets = pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64())) if whole else pa.array([fold(g) for g in found], pa.binary())
            columns = [pa.array([node_of(g) for g in found], pa.int64()), pa.array([len(g) for g in found], pa.int64()), sets]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", name])

    again = _among(source, "doc_id", ids.select("_id")).select("text").mapInArrow(read, f"node long, size long, {name} {kind}")
    return again.join(ids.select("node"), "node").groupBy("node").agg(F.first("size").alias("size"), F.first(name).alias(name))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, rep, n, a, m, b: pairs (node, rep) with size and set of both; one shuffle of the sets serves both joins."""
    name = sets.columns[-1]
    a, b = sets.alias("a"), sets.alias("b")
    half = pairs.select(F.col("node").alias("_node"), "rep").join(b, F.col("rep") == F.col("b.node")).select("_node", "rep", F.col("b.size").alias("_m"), F.col(f"b.{name}").alias("_b"))
    both = half.join(a, F.col("_node") == F.col("a.node"))
    return both.select(F.col("_node").alias("node"), "rep", F.col("a.size").alias("n"), F.col(f"a.{name}").alias("a"), F.col("_m").alias("m"), F.col("_b").alias("b"))


def overlap(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Members in common of two sorted sets, or -1 if their sizes leave fewer than `least`."""
    if min(len(a), len(b)) < least:
        return -1
    return len(np.intersect1d(a, b, assume_unique=True))


class Incidence:
    """Document by n-gram incidence of a block of documents, by rows and by columns, the rarest columns first."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray | None = None):
        held = np.array([len(s) for s in sets], np.int64)
        self.sizes = held if sizes is None else sizes
        self._lost = self.sizes - held
        _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(often, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        column = rank[column]
        row = np.repeat(np.arange(len(sets)), held)
        by_row, by_column = np.lexsort((column, row)), np.lexsort((row, column))
        self._columns, self._rows = column[by_row], row[by_column]
        self._row_ends = np.concatenate([[0], np.cumsum(held)])
        self._column_ends = np.concatenate([[0], np.cumsum(often[order])])

    def linked(self, i: int, open_: np.ndarray, percent: int, width: int = 128) -> np.ndarray:
        """The rows of the mask `open_` that link with row i.

        Row i times the incidence goes over blocks of `width` of its columns. After each, rows are left
        out whose overlap can't reach the bound of their sizes with the columns still to come. Of
        folded sets, which may have lost members, those are found that may link.
        """
        least = least_overlap(percent, int(self.sizes[i]), self.sizes)
        alive = open_ & (np.minimum(self.sizes, self.sizes[i]) >= least)
        need = least - np.minimum(self._lost, self._lost[i])
        own = self._columns[self._row_ends[i] : self._row_ends[i + 1]]
        count = np.zeros(len(self.sizes), np.int64)
        for at in range(0, len(own), width):
            if not alive.any():
                break
            some = own[at : at + width]
            first, long = self._column_ends[some], np.diff(self._column_ends)[some]
            inside = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            count += np.bincount(self._rows[np.repeat(first, long) + inside], minlength=len(count))
            alive &= count + max(0, len(own) - at - width) >= need
        return np.flatnonzero(alive)


def block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) between documents of a block that may still join two components.

    `group` has node, linked and near (to the key's representative), label, and grams or, with size,
    folded sets. Documents apart from the representative meet each other, and the linked ones if they
    are near it. Pairs within a component are left out, also those that a new link joins.
    """
    if "folded" in group:
        block = Incidence([np.frombuffer(f, "<u2") for f in group["folded"]], group["size"].to_numpy())
    else:
        block = Incidence(group["grams"].tolist())
    node, label = group["node"].to_numpy(), group["label"].to_numpy().copy()
    linked, near = group["linked"].to_numpy(bool), group["near"].to_numpy(bool)
    found = []
    for i in np.flatnonzero(~linked):
        others = (label != label[i]) & (~linked | near[i])
        others[: i + 1] &= linked[: i + 1]
        for j in block.linked(i, others, percent) if others.any() else ():
            if label[i] != label[j]:
                found.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def fold(grams: np.ndarray) -> bytes:
    """A set by the last 16 bits of its members. Two sets have at most as many more members in common than folds as one lost."""
    return np.unique((grams & np.uint64(0xFFFF)).astype("<u2")).tobytes()


def _merged(status: DataFrame, tested: DataFrame) -> DataFrame:
    """`status` (key, node, linked, near), with the keys of one representative as one key where that costs less.

    Groups of copies meet in many keys with much the same documents, and would be compared again in
    each. One key has every pair of the keys it stands for, so no link is lost. Costs are counted in
    pairs of documents, with `row` for what a document costs by itself.
    """
    row = 64
    cost = (F.count_if(~F.col("linked")) + row) * F.count(F.lit(1))
    apart = status.groupBy("key").agg(F.min("rep").alias("rep"), cost.alias("_cost")).groupBy("rep").agg(F.sum("_cost").alias("_apart"))
    merged = saved(tested.groupBy("rep").agg(cost.alias("_merged")).join(apart, "rep").where("_merged <= _apart").select("rep", F.lit(True).alias("_one")), "merged")
    columns = ["key", "node", "linked", "near"]
    own = status.join(merged, "rep", "left").where("_one is null").select(*columns)
    return own.unionByName(tested.join(merged, "rep").withColumn("key", F.xxhash64("rep", F.lit("rep"))).select(*columns))


def _open_blocks(met: DataFrame, tested: DataFrame, labels: DataFrame, sets: DataFrame, policy: JoinPolicy) -> DataFrame:
    """Documents in pairs of row blocks, of the keys where a link may still join two components.

    Of keys with the same documents one is taken. A key with many documents is dealt into row
    blocks, every two of which meet.
    """
    status = _merged(saved(met.join(tested, ["node", "rep"]), "status"), tested)
    keys = (
        status.groupBy("key")
        .agg(
            F.count_if(~F.col("linked")).alias("_apart"),
            F.bool_or(~F.col("linked") & F.col("near")).alias("_all"),
            F.bool_or("linked").alias("_linked"),
        )
        .where("_apart > 1 or _all and _linked")
        .select("key", "_all")
    )
    members = saved(
        status.join(keys, "key")
        .where("not linked or _all")
        .select("key", "node", "linked", "near")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node")),
        "members",
    )
    blocks = (
        members.join(sets.select("node", F.col("size").alias("_n")), "node")
        .groupBy("key")
        .agg(
            F.min("label").alias("_low"),
            F.max("label").alias("_high"),
            F.count(F.lit(1)).alias("_rows"),
            F.sum("_n").alias("_entries"),
            F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("_sum"),
        )
        .where("_low <> _high")
        .groupBy("_rows", "_entries", "_sum")
        .agg(F.min("key").alias("key"))
        .select(
            "key",
            F.greatest(F.ceil(F.col("_rows") / policy.block_rows), F.ceil(F.col("_entries") / policy.block_entries)).cast("int").alias("_blocks"),
        )
    )
    return (
        members.join(blocks, "key")
        .withColumn("_block", F.pmod(F.xxhash64("node", "key"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("key", F.least("_block", "_other").alias("_first"), F.greatest("_block", "_other").alias("_second"), "node", "linked", "near", "label")
    )


def _links_in(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """block_links of every pair of row blocks (key, _first, _second), with what `sets` holds of each node."""
    block = ["key", "_first", "_second"]

    def links(at: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = block_links(group.drop_duplicates("node").sort_values("node", ignore_index=True), percent)
        return found.assign(**dict(zip(block, at)))[[*block, "a", "b"]]

    return dealt.join(sets, "node").groupBy(*block).applyInPandas(links, "key long, _first int, _second int, a long, b long")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, rep, linked and near of pairs (node, rep): whether their Jaccard reaches percent, and 2 * percent - 100, hundredths.

    Of folded sets, whether it may: they have at most as many more members in common than folds as one lost.
    """
    far = 2 * percent - 100

    if "folded" in sets.columns:
        members = lambda held: np.frombuffer(held.as_buffer(), "<u2")
    else:
        members = lambda held: np.asarray(held.values)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            sizes = np.asarray(batch["n"]) + np.asarray(batch["m"])
            least = -(-far * sizes // (100 + far))
            for n, m, a, b, need in zip(batch["n"].to_pylist(), batch["m"].to_pylist(), batch["a"], batch["b"], least.tolist()):
                if min(n, m) < need:
                    both.append(-1)
                    continue
                a, b = members(a), members(b)
                lost = min(n - len(a), m - len(b))
                both.append(lost + overlap(a, b, need - lost))
            shared = np.array(both, np.int64)
            flags = [pa.array(shared * (100 + bound) >= bound * sizes) for bound in (percent, far)]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["rep"], *flags], names=["node", "rep", "linked", "near"])

    return _with_sets(pairs, sets).mapInArrow(compare, "node long, rep long, linked boolean, near boolean")


def confirmed(pairs: DataFrame, whole, percent: int) -> DataFrame:
    """`compared` of pairs (node, rep; a stored table) on whole sets, stored; whole(nodes) reads these."""
    ends = pairs.select("node").unionByName(pairs.select(F.col("rep").alias("node"))).distinct()
    sets = whole(ends)
    sure = saved(compared(pairs, sets, percent), "sure")
    forget(sets)
    return sure


def more_links(dealt: DataFrame, sets: DataFrame, whole, policy: JoinPolicy) -> DataFrame:
    """Links within blocks of rows: found on folded sets, a quarter of the bytes, then compared on whole ones.

    A block with a pair that whole sets don't confirm is done again with whole sets, as other pairs
    were left out for it.
    """
    block = ["key", "_first", "_second"]
    nodes = saved(dealt.select("node").distinct(), "nodes")
    found = saved(_links_in(dealt, _among(sets, "node", nodes), policy.percent), "found")
    pairs = saved(found.select(F.col("a").alias("node"), F.col("b").alias("rep")).distinct(), "again")
    if pairs.isEmpty():
        forget(nodes, pairs)
        return found.select("a", "b")
    again = confirmed(pairs, whole, policy.percent)
    sure = again.select(F.col("node").alias("a"), F.col("rep").alias("b"), "linked")
    links = sure.where("linked").select("a", "b")
    wrong = found.join(sure.where("not linked"), ["a", "b"]).select(*block).distinct()
    if not sure.where("not linked").isEmpty():
        unsure = saved(dealt.join(wrong, block), "unsure")
        links = links.unionByName(_links_in(unsure, whole(unsure.select("node").distinct()), policy.percent).select("a", "b"))
    stored = saved(links, "links")
    forget(nodes, found, again, pairs)
    return stored


def join_documents(docs: DataFrame, policy: JoinPolicy = JoinPolicy()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text and any other columns).

    Documents with equal sets are one set. Sets that agree in a whole block of columns meet: each
    with the least of its key, and those apart from it with each other, in blocks of rows. One minus
    Jaccard is a metric, so a set that shares less than 2 * percent - 100 hundredths with the least one
    can't link to sets that link to it. Sets are compared folded to 16 bits, and what may link by these
    on whole sets, which are read from the texts again. Rows without words link to nothing, not to each other. Rows
    without id count as any other; a component has the least id in it, null if there is none. An
    empty table gives an empty result.
    """
    sketches = saved(sketch_sets(docs, policy), "sketches")
    met = saved(meetings(sketches, policy), "met")
    rows = saved(sketches.select("doc_id", "node", "size"), "rows")
    forget(sketches)
    pairs = saved(met.select("node", "rep").distinct(), "pairs")
    percent = policy.percent
    ids = saved(least_ids(rows, pairs.select("node").unionByName(pairs.select(F.col("rep").alias("node"))).distinct()), "ids")
    sets = saved(sets_of(docs, ids, policy, whole=False), "sets")

    def whole(nodes: DataFrame) -> DataFrame:
        return saved(sets_of(docs, saved(ids.join(nodes, "node"), "ids"), policy, whole=True), "whole")

    guessed = saved(compared(pairs, sets, percent), "guessed")
    likely = saved(guessed.where("linked").select("node", "rep"), "likely")
    sure = confirmed(likely, whole, percent)
    tested = saved(guessed.where("not linked").unionByName(sure), "tested")
    forget(guessed, likely, sure)
    links = tested.where("linked").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    labels = components(links)

    dealt = saved(_open_blocks(met, tested, labels, sets, policy), "dealt")
    more = more_links(dealt, sets, whole, policy)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    lowest = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_id"), F.count(F.lit(1)).alias("_rows"))
    named = lowest.join(labels, "node", "left")
    apart = named.where("label is null and _rows > 1").select("node", F.col("_id").alias("component_id"))
    joined = named.where("label is not null")
    least = joined.groupBy("label").agg(F.min("_id").alias("component_id"))
    of_node = saved(apart.unionByName(joined.join(least, "label").select("node", "component_id")).withColumn("_in", F.lit(True)), "components")
    forget(met, pairs, ids, sets, tested, dealt)
    return rows.join(of_node, "node", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op12_ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return join_documents(docs)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g
  FROM d
), u AS (
  SELECT min(doc_id) AS doc_id, g, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s) WHERE len(g) > 0 GROUP BY g
), x AS (
  SELECT doc_id, n, unnest(g) AS gram FROM u
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM o UNION ALL SELECT b, a FROM o
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM u UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
), c AS (
  SELECT node, min(reached) AS component_id FROM r GROUP BY node
), k AS (
  SELECT u.g, c.component_id FROM u JOIN c ON u.doc_id = c.node
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN k ON list_sort(s.g) = k.g AND len(s.g) > 0
"""
