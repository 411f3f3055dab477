"""Language identification with n-gram presence kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import doc_crc, spread

_CHUNK = 1 << 20
#: Dense rows in memory at once.
_ROWS = 32
#: Texts fitted at once as byte rows, and buckets widened at once.
_FITTED = 256
_BLOCK = 4096


@dataclass(frozen=True)
class LanguagePolicy:
    """Bounds of the labelled sample, the kernel, and what counts as a known language.

    At most per_language texts of each of the max_languages most frequent languages are fitted, longer
    ones than max_chars code points by windows spread over the whole text. Scoring has no bounds. A text is known if its likeness to the
    predicted language is at least likeness_share times that of the least alike hundredth of the
    fitted texts.
    """

    per_language: int = 600
    max_languages: int = 64
    max_chars: int = 20_000
    landmarks: int = 320
    longest: int = 4
    buckets: int = 1 << 16
    ridge: float = 1e-3
    min_score: float = 0.2
    window: int = 4096
    likeness_share: float = 0.6


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and the kernel expansion as one weight per n-gram bucket and language.

    shares is the share of a language's landmarks that hold a bucket, attainable the largest sum of
    shares that a number of buckets can have, least the likeness below which a text is unlike the language.
    """

    languages: list[str]
    weights: np.ndarray
    longest: int
    window: int
    shares: np.ndarray
    attainable: np.ndarray
    least: np.ndarray


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_of(text: str | None) -> np.ndarray:
    """Code points in lower case, each run of anything but letters as one space; empty if it has no letter."""
    if not isinstance(text, str):
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(is_letter, codes, np.uint32(32))
    first = np.ones(len(codes), bool)
    first[1:] = is_letter[1:] | is_letter[:-1]
    return codes[first]


def mark_ngrams(codes: np.ndarray, row: np.ndarray, longest: int) -> None:
    """Set row[bucket] = 1 for every n-gram of 1 to `longest` code points (blended spectrum, presence)."""
    shift = np.uint32(32 - int(len(row)).bit_length() + 1)
    for start in range(0, len(codes), _CHUNK):
        part = codes[start : start + _CHUNK + longest - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, min(longest, len(part)) + 1):
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(n)
            row[(h * np.uint32(2654435761)) >> shift] = 1


def presence(texts: Sequence[str | None], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Presence rows of texts, scaled to unit length, and which texts have a letter."""
    rows, has = np.zeros((len(texts), buckets), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        codes = letters_of(text)
        has[i] = len(codes) > 0
        if has[i]:
            mark_ngrams(codes, rows[i], longest)
            rows[i] /= np.sqrt(rows[i].sum())
    return rows, has


class _Presence:
    """Presence rows of texts, a byte a bucket; they are widened a block of buckets at a time."""

    def __init__(self, texts: Sequence[str], buckets: int, longest: int):
        self.held = np.zeros((len(texts), buckets), np.uint8)
        for row, text in zip(self.held, texts):
            mark_ngrams(letters_of(text), row, longest)
        self._norm = np.sqrt(np.maximum(self.held.sum(1, dtype=np.int64), 1)).astype(np.float32)

    def kernel(self, other: _Presence) -> np.ndarray:
        found = np.zeros((len(self.held), len(other.held)), np.float32)
        for start in range(0, self.held.shape[1], _BLOCK):
            part = slice(start, start + _BLOCK)
            found += self.held[:, part].astype(np.float32) @ other.held[:, part].astype(np.float32).T
        return found / self._norm[:, None] / other._norm

    def weights(self, expansion: np.ndarray) -> np.ndarray:
        """One weight per bucket and column of the expansion over these rows."""
        scaled = (expansion / self._norm[:, None]).astype(np.float32)
        blocks = range(0, self.held.shape[1], _BLOCK)
        return np.vstack([self.held[:, start : start + _BLOCK].T.astype(np.float32) @ scaled for start in blocks])


def likeness(codes: np.ndarray, shares: np.ndarray, attainable: np.ndarray, longest: int, window: int) -> np.ndarray:
    """Kernel mass of a text with each language's landmarks, as a share of the largest that as many n-grams can have.

    The mean over windows of the whole text, so that it doesn't depend on length. Zero if there is no letter.
    """
    parts = max(1, round(len(codes) / window))
    bounds = np.linspace(0, len(codes), parts + 1).astype(int)
    total = np.zeros(shares.shape[1])
    for start, end in zip(bounds[:-1], bounds[1:]):
        row = np.zeros(len(shares), np.uint8)
        mark_ngrams(codes[start:end], row, longest)
        held = np.flatnonzero(row)
        total += shares[held].sum(0) / np.maximum(attainable[len(held)], 1e-9)
    return total / parts


def _least_likeness(
    by_language: list[list[int]], texts: Sequence[str], landmarks: set[int], shares: np.ndarray, policy: LanguagePolicy
) -> tuple[np.ndarray, np.ndarray]:
    """The attainable sums of shares, and the least likeness by language, from fitted texts that aren't landmarks.

    A language without such texts has the least likeness of the others, or 0 if there are none.
    """
    attainable = np.vstack([np.zeros(shares.shape[1]), np.cumsum(-np.sort(-shares.astype(np.float64), axis=0), axis=0)])
    least = np.full(len(by_language), np.nan)
    for k, group in enumerate(by_language):
        others = [
            likeness(letters_of(texts[i]), shares[:, [k]], attainable[:, [k]], policy.longest, policy.window)[0] for i in group if i not in landmarks
        ]
        if others:
            least[k] = policy.likeness_share * np.quantile(others, 0.01)
    return attainable, np.where(np.isnan(least), 0.0 if np.isnan(least).all() else np.nanmin(least), least)


def train_language(texts: Sequence[str], langs: Sequence[str], policy: LanguagePolicy = LanguagePolicy()) -> LanguageModel | None:
    """One-versus-rest kernel ridge regression on Nyström features.

    The kernel of two texts is the number of n-grams in both over the root of the product of their
    numbers. Landmarks are dealt evenly over languages. As the kernel is linear in presence, the
    expansion over landmarks is summed up into one weight per bucket and language. None without texts.
    """
    languages = sorted(set(langs))
    if not languages:
        return None
    by_language = [[i for i, lang in enumerate(langs) if lang == name] for name in languages]
    turns = [i for group in zip(*(g + [-1] * (max(map(len, by_language)) - len(g)) for g in by_language)) for i in group if i >= 0]
    chosen = turns[: policy.landmarks]
    landmarks = _Presence([texts[i] for i in chosen], policy.buckets, policy.longest)
    of_language = np.array([langs[i] for i in chosen])
    shares = np.stack([landmarks.held[of_language == name].mean(0, dtype=np.float32) for name in languages], axis=1)
    values, vectors = np.linalg.eigh(landmarks.kernel(landmarks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    gram, moment = np.zeros((keep.sum(), keep.sum())), np.zeros((keep.sum(), len(languages)))
    for start in range(0, len(texts), _FITTED):
        rows = _Presence(texts[start : start + _FITTED], policy.buckets, policy.longest)
        features = rows.kernel(landmarks).astype(np.float64) @ root
        target = np.where(np.array(langs[start : start + _FITTED])[:, None] == np.array(languages), 1.0, -1.0)
        gram += features.T @ features
        moment += features.T @ target
    solved = np.linalg.solve(gram + policy.ridge * len(texts) * np.eye(len(gram)), moment)
    attainable, least = _least_likeness(by_language, texts, set(chosen), shares, policy)
    weights = landmarks.weights(root @ solved)
    return LanguageModel(languages, weights, policy.longest, policy.window, shares, attainable, least)


def language_sample(docs: DataFrame, policy: LanguagePolicy) -> tuple[list[str], list[str]]:
    """Texts and languages outside the held-out fold; ids are drawn per language by a hash of the id.

    One pass counts languages, one draws the ids, and one reads the texts drawn. Of an id on several rows
    the first language and the first text count, by comparison, so reruns agree and the driver gets a row an id.
    """
    spark = docs.sparkSession
    fold = docs.select(F.col("doc_id").cast("long"), "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.pmod(doc_crc(F.col("doc_id")), F.lit(4)) != 2)
    )
    # One row an id; an id on rows of several languages has the first by name.
    fold = fold.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    frequent = fold.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(policy.max_languages)
    # Twice as many as wanted pass by the size of the hash, so that a frequent language is no large group.
    draw, all_draws = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)), 1 << 40
    few = F.col("_draw") <= F.lit(all_draws) * F.lit(2.0 * policy.per_language + 100) / F.col("_n")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "doc_id"))
    drawn = (
        fold.withColumn("_draw", draw).join(F.broadcast(frequent), "lang").where(few).withColumn("_turn", turn).where(F.col("_turn") <= policy.per_language)
    )
    ids = sorted((r.doc_id, r.lang) for r in drawn.select("doc_id", "lang").collect())
    if not ids:
        return [], []
    sample = F.broadcast(spark.createDataFrame(ids, "doc_id long, _lang string"))
    rows = (
        docs.select(F.col("doc_id").cast("long"), spread(F.col("text"), policy.max_chars).alias("text"))
        .where(F.col("text").isNotNull())
        .join(sample, "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.min("_lang").alias("_lang"))
        .toPandas()
        .sort_values("doc_id")
        .sample(frac=1.0, random_state=11)
    )
    rows = rows[[len(letters_of(t)) > 0 for t in rows["text"]]]
    return rows["text"].tolist(), rows["_lang"].tolist()


def identify_language(docs: DataFrame, model: LanguageModel | None, likeness_too: bool = True, column: str = "_language") -> DataFrame:
    """`docs` (doc_id, text and any other columns) with `column`: struct<lang_pred, score, known>.

    `und` with score 0 if the text is null or has no letter, or without a model. It is known if the text
    is like the language predicted, which is not looked at without likeness_too. Whole texts count;
    of equally likely languages the first by name is predicted.
    """
    kind = "lang_pred string, score double, known boolean"
    if model is None:
        nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("known"))
        return docs.withColumn(column, nothing)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(kind)
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        names = np.array([*m.languages, "und"], dtype=object)
        for texts in batches:
            out = []
            for start in range(0, len(texts), _ROWS):
                some = texts.iloc[start : start + _ROWS].tolist()
                rows, has = presence(some, len(m.weights), m.longest)
                values = rows @ m.weights
                best = np.where(has, values.argmax(1), len(m.languages))
                score = np.where(has, np.clip((values.max(1).astype(np.float64) + 1) / 2, 0.0, 1.0), 0.0)
                known = np.zeros(len(some), bool)
                for i in np.flatnonzero(has) if likeness_too else ():
                    k = [best[i]]
                    known[i] = likeness(letters_of(some[i]), m.shares[:, k], m.attainable[:, k], m.longest, m.window)[0] >= m.least[best[i]]
                out.append(pd.DataFrame({"lang_pred": names[best], "score": score, "known": known}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": [], "known": []})

    return docs.withColumn(column, identify(F.col("text")))


def fitted(docs: DataFrame, policy: LanguagePolicy = LanguagePolicy()) -> LanguageModel | None:
    """The model fitted on the labelled sample of these documents."""
    return train_language(*language_sample(docs, policy), policy)


def op7_language(docs: DataFrame, policy: LanguagePolicy = LanguagePolicy()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    found = identify_language(docs.select("doc_id", "text"), fitted(docs, policy), likeness_too=False)
    return found.select(
        "doc_id",
        F.coalesce(F.pmod(doc_crc(F.col("doc_id")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        "_language.lang_pred",
        "_language.score",
    )
