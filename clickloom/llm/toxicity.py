"""Toxicity by compression distance between two Zstandard dictionaries."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import doc_crc, spread

_WORD = re.compile(r"\w+")
#: Distances are counted from -1 (or less) to this (or more) bytes.
_FARTHEST = 6
#: Summed evidence beyond this doesn't change the score.
_ENOUGH = 6.0


@dataclass(frozen=True)
class ToxicityPolicy:
    """Bounds of the labelled sample and shape of windows and dictionaries.

    At most max_toxic and max_ordinary labelled documents are fitted, however large the corpus is,
    longer ones than max_chars code points by windows spread over the whole text. The toxic
    dictionary has toxic_share of the bytes that it is trained on, within toxic_bytes. Scoring has no bounds.
    """

    max_toxic: int = 1500
    max_ordinary: int = 5000
    max_chars: int = 30_000
    window_words: int = 24
    ordinary_bytes: int = 4_000_000
    toxic_share: float = 0.02
    toxic_bytes: tuple[int, int] = (4096, 32_768)
    level: int = 7
    threshold: float = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries, evidence by window distance, and the line that makes a score of summed evidence."""

    ordinary: bytes
    toxic: bytes
    level: int
    window_words: int
    evidence: np.ndarray
    slope: float
    intercept: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Scores of texts by their windows at each distance."""
        return 1 / (1 + np.exp(-np.clip(self.slope * bounded(counts, self.evidence) + self.intercept, -30, 30)))


def bounded(counts: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Summed evidence within -_ENOUGH and _ENOUGH, so that wrongly labelled long texts don't bend the curve."""
    return np.clip(counts @ evidence, -_ENOUGH, _ENOUGH)


def windows_of(text: str | None, size: int) -> list[bytes]:
    """The whole text in windows of `size` successive words in lower case; none for null or without words."""
    words = _WORD.findall(text.lower()) if isinstance(text, str) else []
    return [f" {' '.join(words[i : i + size])} ".encode("utf-8", "replace") for i in range(0, len(words), size)]


class WindowDistance:
    """How many bytes shorter a window compresses where the toxic dictionary stands before the ordinary one.

    Ordinary words have the same matches in both cases, so distances aren't blurred by which of them
    happen to be in one dictionary only.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, level: int):
        self._ordinary, self._toxic = self._compressor(ordinary, level), self._compressor(toxic + ordinary, level)

    @staticmethod
    def _compressor(content: bytes, level: int):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=512, dict_size=len(content), min_match=4, write_content_size=0, write_dict_id=0, write_checksum=0
        )
        dictionary.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress

    def counts(self, text: str | None, size: int) -> np.ndarray:
        """Windows of a text at each distance from -1 to _FARTHEST."""
        found = [len(self._ordinary(w)) - len(self._toxic(w)) for w in windows_of(text, size)]
        return np.bincount(np.clip(np.array(found, np.int64), -1, _FARTHEST) + 1, minlength=_FARTHEST + 2)


def _trained(samples: Sequence[bytes], size: int) -> bytes:
    """A dictionary trained on whole samples, cut where they are long; of too few, the end of what they hold."""
    parts = [s[i : i + 2000] for s in samples for i in range(0, len(s), 2000)]
    try:
        return zstandard.train_dictionary(size, [p for p in parts if len(p) > 50], k=16, d=6, split_point=1.0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b" "


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and intercept of the logistic curve through one feature, by Newton's method."""
    scale = np.abs(x).max() + 1e-9
    both, w, penalty = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2), np.array([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(both @ w, -30, 30)))
        step = np.linalg.solve((both * (p * (1 - p))[:, None]).T @ both + np.diag(penalty), both.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0] / scale)), float(w[1])


def train_toxicity(toxic: Sequence[str], ordinary: Sequence[str], policy: ToxicityPolicy = ToxicityPolicy()) -> ToxicityModel | None:
    """Fit on labelled texts; None if a class has fewer than two texts.

    The first half of the toxic and two thirds of the ordinary texts, whole, make the dictionaries:
    the ordinary one is their content itself (a few MB), so that even rare ordinary words are in it;
    the toxic one is trained, so that it holds what toxic texts repeat. The other texts calibrate:
    a distance counts as evidence by the log ratio of how often toxic and ordinary texts' windows
    have it, and a logistic curve makes the score of a text's summed evidence.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    h, g = (len(toxic) + 1) // 2, min(len(ordinary) - 1, (2 * len(ordinary) + 2) // 3)
    base = "\n".join(t.lower() for t in ordinary[:g]).encode("utf-8", "replace")[: policy.ordinary_bytes] or b" "
    samples = [t.lower().encode("utf-8", "replace") for t in toxic[:h]]
    least, most = policy.toxic_bytes
    extra = _trained(samples, min(most, max(least, int(policy.toxic_share * sum(map(len, samples))))))
    distance = WindowDistance(base, extra, policy.level)
    counts = np.array([distance.counts(t, policy.window_words) for t in toxic[h:] + ordinary[g:]])
    y = np.r_[np.ones(len(toxic) - h), np.zeros(len(ordinary) - g)]
    seen = [counts[y == k].sum(0) + 0.5 for k in (1, 0)]
    evidence = np.log(seen[0] / seen[0].sum()) - np.log(seen[1] / seen[1].sum())
    return ToxicityModel(base, extra, policy.level, policy.window_words, evidence, *_line(bounded(counts, evidence), y))


def labelled_sample(docs: DataFrame, labels: DataFrame, policy: ToxicityPolicy) -> tuple[list[str], list[str]]:
    """Toxic and ordinary texts outside the held-out fold, at most as many as the policy says.

    Ids are taken in the order of a hash of the id; only their texts are read. A document with
    several labels counts as toxic if one says so; null ids, labels and texts are left out. Of an id on
    several rows the first text counts, by comparison, so reruns agree and the driver gets a row an id.
    """
    spark = docs.sparkSession
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.pmod(doc_crc(F.col("doc_id")), F.lit(3)) != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    ids = [
        (r.doc_id, r.toxic)
        for toxic, n in ((1, policy.max_toxic), (0, policy.max_ordinary))
        for r in known.where(F.col("toxic") == toxic).orderBy(*order).limit(n).collect()
    ]
    if not ids:
        return [], []
    sample = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))
    rows = (
        docs.select(F.col("doc_id").cast("long"), spread(F.col("text"), policy.max_chars).alias("text"))
        .where(F.col("text").isNotNull())
        .join(sample, "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .toPandas()
        .sort_values("doc_id")
        .sample(frac=1.0, random_state=7)
    )
    return rows["text"][rows["toxic"] == 1].tolist(), rows["text"][rows["toxic"] == 0].tolist()


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, column: str = "score") -> DataFrame:
    """`docs` (doc_id, text and any other columns) with the score in `column`.

    The score is between 0 and 1; null and empty texts have the score of a text without windows;
    without a model every score is 0. Whole texts are scored.
    """
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        distance = WindowDistance(m.ordinary, m.toxic, m.level)
        for texts in batches:
            counts = [distance.counts(t, m.window_words) for t in texts]
            yield pd.Series(m.score(np.array(counts)) if counts else [], dtype="float64")

    return docs.withColumn(column, score(F.col("text")))


def fitted(docs: DataFrame, labels: DataFrame, policy: ToxicityPolicy = ToxicityPolicy()) -> ToxicityModel | None:
    """The model fitted on the labelled sample of these tables; warns if there are labels but too few of a class."""
    toxic, ordinary = labelled_sample(docs, labels, policy)
    model = train_toxicity(toxic, ordinary, policy)
    if model is None and (toxic or ordinary):
        warnings.warn(f"toxicity can't be fitted on {len(toxic)} toxic and {len(ordinary)} ordinary texts: every score is 0", stacklevel=2)
    return model


def op6_toxicity(docs: DataFrame, labels: DataFrame, policy: ToxicityPolicy = ToxicityPolicy()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), fitted(docs, labels, policy))
    return scored.select(
        "doc_id",
        F.coalesce(F.pmod(doc_crc(F.col("doc_id")), F.lit(3)) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= policy.threshold, 1).otherwise(0).alias("predicted"),
    )
