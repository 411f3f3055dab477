"""Pack tokenized documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import saved

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, special strings in texts included.

    tiktoken does the work from the same vocabulary as ranks (equal ids, several times faster); a
    text that it refuses goes to the tokenizers library.
    """

    def __init__(self, ranks_file: str, json_file: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._json_file, self._slow = json_file, None

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self._encoding.encode_to_numpy(text, allowed_special="all"), dtype="<u4")
        except BaseException as error:  # its native part raises a panic that isn't an Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._json_file)
            return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def byte_bpe() -> ByteBpe:
    """The public 50k vocabulary; files are found by name on each machine."""
    import public_tokenizers as public

    return ByteBpe(
        public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN, {"<|endoftext|>": 50256}
    )


def document_pieces(ids: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """start, length and checksum of the whole windows of a document and of what remains."""
    for start in range(0, len(ids), window):
        piece = ids[start : start + window]
        yield start, len(piece), zlib.crc32(piece.tobytes())


def minimum_bin_slack(lengths: Sequence[int], window: int) -> list[list[int]]:
    """Bins of positions of `lengths`, each filled as closely to `window` as the rest allows.

    The longest remaining piece opens a bin. A bitset holds the sums that the remaining multiset of
    lengths can reach within the space left; lengths enter it from long to short, each with its
    count in binary shares, until the space is met exactly or all are in. The best sum is then
    traced back through the bitsets to counts per length. Pieces over `window` are an error.
    """
    at: dict[int, list[int]] = {}
    for position, length in enumerate(lengths):
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} tokens doesn't fit a window of {window}")
        at.setdefault(length, []).append(position)
    count = Counter({length: len(positions) for length, positions in at.items()})
    descending = sorted(count, reverse=True)
    bins = []
    while descending:
        first = descending[0]
        chosen = Counter({first: 1})
        count[first] -= 1
        space = window - first
        reach, mask, steps = 1, (1 << (space + 1)) - 1, []
        for length in descending:
            copies = min(count[length], space // length)
            if copies <= 0:
                continue
            steps.append((length, copies, reach))
            share = 1
            while copies:
                part = min(share, copies)
                reach |= (reach << (length * part)) & mask
                copies -= part
                share *= 2
            if reach >> space & 1:
                break
        total = reach.bit_length() - 1
        for length, copies, before in reversed(steps):
            used = next(k for k in range(copies + 1) if total >= k * length and before >> (total - k * length) & 1)
            if used:
                chosen[length] += used
                count[length] -= used
                total -= used * length
        bins.append([at[length].pop() for length, used in chosen.items() for _ in range(used)])
        descending = [length for length in descending if count[length]]
    return bins


def pack_documents(docs: DataFrame, window: int = 2048, end_id: int = 1, group_pieces: int = 2048) -> DataFrame:
    """Pieces of all documents and their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with `end_id`. Whole windows are sequences of their own; the remainders are
    dealt at random into groups of about `group_pieces`, and minimum bin slack packs each group, so
    a group wastes about one window's padding however large the corpus is. Null text is empty; a
    document always has its end id; repeated rows are packed each. Tokens never leave the task that
    made them: only piece rows are shuffled. Sequence ids are even for whole windows, odd for packed.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = byte_bpe()
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.concatenate([tokenizer.encode(text), end]) if isinstance(text, str) and text else end
                rows += [(doc_id, start, n, crc, len(ids)) for start, n, crc in document_pieces(ids, window)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    cut_docs = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInPandas(cut, _PIECES)
    pieces = saved(cut_docs.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    rest = pieces.where(F.col("length") < window)
    groups = max(1, math.ceil(rest.count() / group_pieces))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece_id", ignore_index=True)
        lengths = group["length"].tolist()
        sequence, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for number, members in enumerate(minimum_bin_slack(lengths, window)):
            place = 0
            for i in members:
                sequence[i], offset[i] = number, place
                place += lengths[i]
        group["sequence_id"] = (group["_group"].astype("int64") * 2**32 + sequence) * 2 + 1
        group["offset"] = offset
        return group[[*columns, "sequence_id", "offset"]]

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    packed = (
        rest.withColumn("_group", F.pmod(F.xxhash64("piece_id"), F.lit(groups)))
        .groupBy("_group")
        .applyInPandas(pack, f"{_PIECES}, sequence_id long, offset long")
    )
    whole = pieces.where(F.col("length") == window).select(
        *columns, (F.col("piece_id") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return whole.unionByName(packed)


def op4_packing(docs: DataFrame) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(docs)
