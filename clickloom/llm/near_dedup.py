"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import forget, saved, unused

_ROWS = 1 << 16
#: Words of a text aligned with the same part of the other.
_CHUNK = 4096


@dataclass(frozen=True)
class NearPolicy:
    """Sketches of `shingle`-word shingles; links from a likeness of aligned words of `similarity` on.

    A sketch has bands * rows hashes, each of the `picks` least occurrence-labelled shingles in text
    order. Two texts that share a part s of their shingles share a hash with probability about
    s ** picks, and a band with that to the power of `rows`. A word changed in nine leaves a likeness
    of 0.8 and about 0.39 of the shingles; one in twenty leaves 0.63, which the bands miss once in 250 pairs.
    Keys of more than hot_members texts are joined apart, as are all beyond the hot_keys most frequent at least.
    """

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 2
    picks: int = 2
    seed: int = 13
    block_members: int = 512
    block_words: int = 1_000_000
    hot_members: int = 256
    hot_keys: int = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    steps = np.full(1 << bits, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (runs of letters and digits, in lower case) of a text, in order."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _word_characters()[codes]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    bits = max(16, int(len(codes)).bit_length())
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, bits)[: len(codes)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * _powers(_BASE_INVERSE, bits)[start])


def with_occurrence(value: np.ndarray) -> np.ndarray:
    """Values with the number of their occurrence mixed in, so that none repeats."""
    n = len(value)
    order = np.argsort(value, kind="stable")
    in_order = value[order]
    new = np.ones(n, bool)
    new[1:] = in_order[1:] != in_order[:-1]
    at = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mix(value + occurrence * np.uint64(0xD6E8FEB86659FD93))


def labelled_shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text in text order, each with its occurrence number mixed in.

    So no value repeats. Fewer words than a shingle are one shingle; without words there is none.
    """
    words = word_hashes(text) if isinstance(text, str) else np.empty(0, np.uint64)
    if not len(words):
        return words
    n = max(1, len(words) - shingle + 1)
    value = np.zeros(n, np.uint64)
    for j in range(min(shingle, len(words))):
        value = value * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n]
    return with_occurrence(_mix(value))


def order_minhash(labelled: np.ndarray, policy: NearPolicy) -> np.ndarray:
    """Band keys of a text's labelled shingles; none for a text without shingles.

    Each hash function ranks the shingles; the `picks` least ones are taken in text order. Long
    texts are ranked in parts, of which only the least ones are kept.
    """
    if not len(labelled):
        return np.empty(0, np.int64)
    count = policy.bands * policy.rows
    seeds = np.random.default_rng(policy.seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    picks, best = min(policy.picks, len(labelled)), None
    for start in range(0, len(labelled), _ROWS):
        rank = labelled[start : start + _ROWS] * seeds[:, None]
        take = min(picks, rank.shape[1])
        at = np.empty((count, take), np.int64)
        for i in range(take):
            at[:, i] = rank.argmin(axis=1)
            rank[np.arange(count), at[:, i]] = np.iinfo(np.uint64).max
        at += start
        if best is not None:
            at = np.concatenate([best, at], axis=1)
            order = np.argsort(labelled[at] * seeds[:, None], axis=1, kind="stable")[:, :picks]
            at = np.take_along_axis(at, order, axis=1)
        best = at
    in_text_order = labelled[np.sort(best, axis=1)]
    value = np.zeros(count, np.uint64)
    for i in range(in_text_order.shape[1]):
        value = _mix(value + in_text_order[:, i])
    key = np.arange(policy.bands, dtype=np.uint64)
    for r in range(policy.rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + value[r :: policy.rows])
    return key.view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches are at most `band` off the diagonal.

    Rows of the alignment are bits of an integer, so that a word of `a` costs a few operations on
    the 2 * band bits around it; of a long text only the rows around _CHUNK words are held at once.
    """
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    a, b = a[head:], b[head:]
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - least :][::-1] != b[len(b) - least :][::-1])
    tail = int(differ[0]) if len(differ) else least
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    states, m = (1 << len(b)) - 1, len(b)
    for top in range(0, len(a), _CHUNK):
        rows = a[top : top + _CHUNK].tolist()
        low, high = max(0, top - band), min(m, top + len(rows) + band)
        if low >= high:
            continue
        places = dict.fromkeys(rows, 0)
        for j, word in enumerate(b[low:high].tolist()):
            if word in places:
                places[word] |= 1 << j
        full = (1 << (high - low)) - 1
        state = states >> low & full
        near, width = (1 << (2 * band + 1)) - 1, top - band - low
        for i, word in enumerate(rows):
            match = state & places[word]
            if match:
                shift = width + i
                match &= near << shift if shift >= 0 else near >> -shift
                state = (state + match | state - match) & full
        states = states & ~(full << low) | state << low
    return head + tail + m - states.bit_count()


def compare(a: np.ndarray, b: np.ndarray, least: float) -> tuple[float, bool]:
    """Likeness of two word sequences by alignment if it is at least `least`, else 0; and whether it may be near that.

    The likeness is L / (n + m - L) for their longest common subsequence L; one minus it is a metric.
    A likeness of `least` leaves a known number of insertions and deletions, so only matches within
    that band of the diagonal can be in the alignment. Words in common in any order are no fewer
    than L, so pairs that have too few are not aligned. The second value is false only if the likeness
    is below 2 * least - 1, so that by the triangle inequality nothing linked to one of the two can
    be linked to the other.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, False
    least -= 1e-9
    far = 2 * least - 1
    if min(n, m) < far * max(n, m):
        return 0.0, False
    common = len(np.intersect1d(with_occurrence(a.view(np.uint64)), with_occurrence(b.view(np.uint64)), assume_unique=True))
    near = common >= far * (n + m - common)
    if common < least * (n + m - common):
        return 0.0, near
    length = aligned(a, b, n + m - 2 * math.ceil(least * (n + m) / (1 + least)))
    likeness = length / (n + m - length)
    return (likeness, True) if likeness >= least else (0.0, near)


def _with_digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def sketch_texts(docs: DataFrame, policy: NearPolicy) -> DataFrame:
    """doc_id, digest, length (shingles) and bands of every row; one pass, nothing is moved."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [labelled_shingles(t, policy.shingle) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "digest": batch["digest"],
                    "length": [len(x) for x in found],
                    "bands": [order_minhash(x, policy) for x in found],
                }
            )

    return _with_digest(docs).mapInPandas(sketch, "doc_id long, digest binary, length long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component, for the nodes of `edges` (a, b).

    Every round takes the least label of a node's neighbours, and the label that this label's node
    had before; each round's labels are one stored table. Links to least nodes need two rounds.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("_seen"))
        around = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("_seen").alias("_least"))
        lower = labels.select("node", "label").join(around, "node").select("node", F.col("label").alias("_old"), F.least("label", "_least").alias("label"))
        before = labels.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        jumped = saved(lower.join(before, "label").select("node", "_old", F.least("label", "_next").alias("label")), "labels")
        done = jumped.where("label <> _old").isEmpty()
        forget(labels)
        labels = jumped
        if done:
            forget(both)
            return labels.select("node", "label")


def open_links(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links (a, b) between members of a block that may still join two components.

    `group` has the bucket's key, node, linked and near (to the bucket's representative), label,
    bands and words. A member apart from the representative meets the others that are apart, and
    the linked ones if it is near. A pair that shares buckets is left to the first of them. Words
    in common are counted with all members at once; only where they suffice is a pair aligned. Pairs
    within a component are left out, also those that a new link joins.
    """
    node, label = group["node"].to_numpy(), group["label"].to_numpy().copy()
    linked, near = group["linked"].to_numpy(bool), group["near"].to_numpy(bool)
    words, bands = group["words"].tolist(), np.stack(group["bands"].to_numpy())
    values = [with_occurrence(w.view(np.uint64)) for w in words]
    earlier = bands[:, : int(np.flatnonzero(bands[0] == group["key"].iloc[0])[0])]
    sizes = np.array([len(v) for v in values])
    ends = np.cumsum(sizes)
    symbols, codes = np.unique(np.concatenate(values), return_inverse=True)
    mark, found = np.zeros(len(symbols), np.int32), []
    for i in np.flatnonzero(~linked):
        others = (label != label[i]) & (~linked | near[i])
        others[:i] &= linked[:i]
        others &= ~(earlier == earlier[i]).any(axis=1)
        if not others.any():
            continue
        own = codes[ends[i] - sizes[i] : ends[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes], ends - sizes)
        mark[own] = 0
        for j in np.flatnonzero(others & (common >= (least - 1e-9) * (sizes[i] + sizes - common))):
            if label[i] != label[j] and compare(words[i], words[j], least)[0] > 0:
                found.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _by_key(left: DataFrame, right: DataFrame, limit: int) -> DataFrame:
    """left joined with right (one row a key) on key and members, the size of the key's bucket.

    Rows of one bucket with more than `limit` members don't meet in a task: the right rows of such
    buckets are few (see near_duplicates) and are broadcast.
    """
    hot = F.col("members") > limit
    return (
        left.where(~hot)
        .join(right.where(~hot), ["key", "members"])
        .unionByName(left.where(hot).join(F.broadcast(right.where(hot)), ["key", "members"]))
    )


def near_duplicates(docs: DataFrame, policy: NearPolicy = NearPolicy()) -> DataFrame:
    """doc_id, digest, class_id and kept for every row of `docs` (doc_id, text and any other columns).

    Exact copies meet by digest. Distinct texts are compared within the buckets of their bands, not
    in all pairs: each with its bucket's first text; those not linked to it with each other, and
    with the linked ones only where the triangle inequality allows a link. So no link within a
    bucket is lost. Classes are connected components; class_id is the least doc_id in a class, and
    `kept` marks the text with that id. Null text is the empty text, and texts without words are
    linked to exact copies only. Rows without doc_id belong to classes, whose id is null if no row
    has one. An empty table gives an empty result.

    Rows of large buckets are joined with their bucket by broadcast: it is large from `limit` members
    on, which grows with the number of keys so that there are at most policy.hot_keys such buckets.
    """
    rows = saved(sketch_texts(docs, policy), "sketches")
    texts = saved(
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("lowest"), F.first("length").alias("length"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    keys = texts.select("node", F.explode("bands").alias("key"))
    limit = max(policy.hot_members, math.ceil(texts.count() * policy.bands / policy.hot_keys))
    firsts = saved(keys.groupBy("key").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("members")).where("members > 1"), "firsts")
    hot = F.broadcast(firsts.where(F.col("members") > limit).withColumnsRenamed({"rep": "_rep", "members": "_members"}))
    placed = keys.join(hot, "key", "left")
    buckets = saved(
        placed.where("_rep is not null")
        .select("key", "node", F.col("_rep").alias("rep"), F.col("_members").alias("members"))
        .unionByName(
            placed.where("_rep is null").select("key", "node").join(firsts.where(F.col("members") <= limit), "key").select("key", "node", "rep", "members")
        )
        .where("node <> rep"),
        "buckets",
    )
    pairs = saved(buckets.select("node", "rep").distinct(), "pairs")

    needed = pairs.select("node").unionByName(pairs.select(F.col("rep").alias("node"))).distinct()
    chosen = texts.join(needed, "node", "left_semi").select("node", F.col("lowest").alias("_id"), F.col("digest").alias("_digest"))
    source = _with_digest(docs)
    again = Window.partitionBy("doc_id", "digest").orderBy("node")
    read = (
        source.join(chosen, F.col("digest").eqNullSafe(F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .withColumn("_turn", F.row_number().over(again))
        .where("_turn = 1")
        .select("node", "text")
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "words": [word_hashes(t).view(np.int64) for t in batch["text"]]})

    words = saved(read.mapInPandas(split, "node long, words array<long>"), "words")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [compare(a, b, policy.similarity) for a, b in zip(batch["words"], batch["_words"])]
            yield pd.DataFrame(
                {"node": batch["node"], "rep": batch["rep"], "linked": [x[0] > 0 for x in found], "near": [x[1] for x in found]}
            )

    tested = saved(
        pairs.join(words.select(F.col("node").alias("rep"), F.col("words").alias("_words")), "rep")
        .join(words, "node")
        .mapInPandas(verify, "node long, rep long, linked boolean, near boolean"),
        "tested",
    )
    links = tested.where("linked").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    labels = components(links)

    status = buckets.where("members > 2").join(tested, ["node", "rep"])
    open_keys = (
        status.groupBy("key", "members")
        .agg(
            F.count_if(~F.col("linked")).alias("_apart"),
            F.count_if(~F.col("linked") & F.col("near")).alias("_near"),
            F.count_if("linked").alias("_linked"),
        )
        .where("_apart > 1 or _near > 0 and _linked > 0")
        .select("key", "members", (F.col("_near") > 0).alias("_all"))
    )
    members = saved(
        _by_key(status, open_keys, limit)
        .where("not linked or _all")
        .select("key", "members", "node", "linked", "near")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .join(texts.select("node", "length", "bands"), "node"),
        "members",
    )
    blocks = (
        members.groupBy("key", "members")
        .agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_s"))
        .where("_low <> _high")
        .withColumn(
            "_blocks", F.greatest(F.ceil(F.col("_n") / policy.block_members), F.ceil(F.col("_s") / policy.block_words)).cast("int")
        )
        .select("key", "members", "_blocks")
    )
    dealt = (
        _by_key(members, blocks, limit)
        .withColumn("_block", F.pmod(F.xxhash64("node", "key"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_first", F.least("_block", "_other"))
        .withColumn("_second", F.greatest("_block", "_other"))
        .join(words, "node")
        .select("key", "_first", "_second", "node", "linked", "near", "label", "bands", "words")
    )

    def rest(group: pd.DataFrame) -> pd.DataFrame:
        return open_links(group.sort_values("node", ignore_index=True), policy.similarity)

    more = saved(dealt.groupBy("key", "_first", "_second").applyInPandas(rest, "a long, b long"), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    forget(firsts, buckets, pairs, words, tested, members, more)

    named = texts.select("node", "digest", "lowest").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("lowest").alias("class_id"), F.min(F.struct(F.col("lowest").isNull(), "lowest", "node")).alias("_best"))
    placed = named.join(classes, "label").select(
        "digest", "class_id", (F.col("node") == F.col("_best.node")).alias("_chosen"), "lowest"
    )
    return rows.select("doc_id", "digest").join(placed, "digest").select(
        "doc_id",
        "digest",
        "class_id",
        (F.col("_chosen") & F.col("doc_id").eqNullSafe(F.col("lowest"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, policy: NearPolicy = NearPolicy()) -> DataFrame:
    """One row of each class: the rows of `docs` with the class's least doc_id, repeated rows once.

    Other columns may have any names. Null texts are empty texts; an empty table stays empty.
    """
    digest, turn, kept_id, kept_digest = (unused(docs.columns, name) for name in ("_digest", "_turn", "_id", "_keep"))
    keep = near_duplicates(docs, policy).where("kept").select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest)).distinct()
    source = docs.withColumn(digest, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    order = [c for c, kind in docs.dtypes if c != "text" and "map<" not in kind]
    first = F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(*order))
    joined = source.join(keep, F.col(digest).eqNullSafe(F.col(kept_digest)) & F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    return joined.withColumn(turn, first).where(F.col(turn) == 1).select(*docs.columns)


def op10_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document; kept marks one document of each class."""
    return near_duplicates(docs).select("doc_id", "class_id", "kept")
