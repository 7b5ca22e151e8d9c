"""Toxicity by a chain of linear classifiers over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix64, rows_of, slices, text_words, total, word_hashes

BUCKETS_LOG2 = 18
#: The chain learns from at most this many labelled rows: those with the least hash of their id.
MOST_LABELLED = 12_000
FOLDS = 3
#: Letters of the beginning of a word that is a feature too, and the labelled rows that a feature must be in.
BEGINNING, LEAST_ROWS = 4, 5
#: Probabilities are fed on no nearer to 0 and 1 than this.
LEAST_P = 1e-6


@dataclass(frozen=True)
class Sparse:
    """Rows of distinct buckets."""

    columns: np.ndarray
    offsets: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return total(w[self.columns], self.offsets)

    def rows(self, chosen: np.ndarray) -> Sparse:
        n = np.diff(self.offsets)[chosen]
        ends = np.r_[0, np.cumsum(n)]
        return Sparse(self.columns[np.repeat(self.offsets[:-1][chosen] - ends[:-1], n) + np.arange(ends[-1])], ends)


def features(texts: pa.Array) -> Sparse:
    """The distinct words of each text and the beginnings of them, by bucket."""
    codes, words, offsets = text_words(texts)
    hashes = [word_hashes(words), mix64(word_hashes(pc.utf8_slice_codeunits(words, 0, BEGINNING)) + np.uint64(1))]
    bucket = np.stack([(h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64) for h in hashes], axis=1)
    key = np.sort((np.repeat(rows_of(offsets), 2) << BUCKETS_LOG2) | bucket[codes].ravel())
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return Sparse(key & ((1 << BUCKETS_LOG2) - 1), np.searchsorted(key >> BUCKETS_LOG2, np.arange(len(offsets))))


def logistic(x: Sparse, extra: np.ndarray, y: np.ndarray, size: int, penalty: float = 1.0, fed_penalty: float = 0.01, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights of buckets and of the extra columns (the last is the intercept) by accelerated gradient steps with a step for each column.

    A bucket counts with the log ratio of its frequencies in positive and negative rows, so that those that both have
    alike, which are most, have little say; buckets in fewer than LEAST_ROWS rows have none. What earlier links say is held
    back less than words are.
    """
    rows = rows_of(x.offsets)
    n_word, n_positive = np.bincount(x.columns, minlength=size), np.bincount(x.columns, y[rows], minlength=size)
    ratio = np.log((n_positive + 1) / (y.sum() + 2)) - np.log((n_word - n_positive + 1) / (len(y) - y.sum() + 2))
    ratio[n_word < LEAST_ROWS] = 0
    reach = np.sqrt(np.diff(x.offsets).mean() + 1)
    rate = np.r_[1 / (0.25 * np.maximum(n_word, 1) * ratio**2 * reach + penalty), 1 / (0.25 * (extra**2).sum(axis=0) * reach + 1e-3)]
    ridge = np.r_[np.full(size, penalty), np.full(extra.shape[1] - 1, fed_penalty), 0]
    at = np.zeros(size + extra.shape[1])
    ahead, momentum = at.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(ratio * ahead[:size]) + extra @ ahead[size:], -30, 30)))
        slope = np.r_[ratio * np.bincount(x.columns, (p - y)[rows], minlength=size), extra.T @ (p - y)]
        new = ahead - rate * (slope + ridge * ahead)
        then = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, at, momentum = new + (momentum - 1) / then * (new - at), new, then
    return ratio * at[:size], at[size:]


@dataclass(frozen=True)
class Chain:
    """One link for each category: weights of buckets, of the earlier categories' probabilities, and an intercept, or a constant: no positives, or only positives."""

    links: list[tuple[np.ndarray, np.ndarray] | float]

    def __call__(self, x: Sparse) -> np.ndarray:
        """The probability of each category; each link is fed those before it."""
        earlier = np.zeros((len(x.offsets) - 1, 0))
        for link in self.links:
            earlier = np.column_stack([earlier, _probability(x, earlier, link)])
        return earlier


def _probability(x: Sparse, earlier: np.ndarray, link: tuple[np.ndarray, np.ndarray] | float) -> np.ndarray:
    n = len(x.offsets) - 1
    if isinstance(link, float):
        return np.full(n, link)
    odds = x.dot(link[0]) + np.column_stack([earlier, np.ones(n)]) @ link[1]
    return np.clip(1 / (1 + np.exp(-np.clip(odds, -30, 30))), LEAST_P, 1 - LEAST_P)


def fit_chain(x: Sparse, y: np.ndarray, fold: np.ndarray) -> Chain:
    """A chain over the columns of y. A later link learns from the earlier ones' out-of-fold predictions, since those for rows
    that a link has learnt from are better than any that it will make."""
    size, links = 1 << BUCKETS_LOG2, []
    earlier = np.zeros((len(y), 0))
    for c in range(y.shape[1]):
        def learn(rows: np.ndarray, c: int = c, earlier: np.ndarray = earlier) -> tuple[np.ndarray, np.ndarray] | float:
            own = y[rows, c]
            if not len(own) or own.min() == own.max():
                return 1.0 if len(own) and own[0] else 0.0
            return logistic(x.rows(rows), np.column_stack([earlier[rows], np.ones(len(rows))]), own, size)

        out = np.zeros(len(y))
        for f in range(FOLDS if c + 1 < y.shape[1] else 0):
            rows = np.flatnonzero(fold == f)
            out[rows] = _probability(x.rows(rows), earlier[rows], learn(np.flatnonzero(fold != f)))
        links.append(learn(np.arange(len(y))))
        earlier = np.column_stack([earlier, out])
    return Chain(links)


def categories(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """of and the categories that toxic and quality tell apart, in the order of the chain: toxic in good prose, toxic in bad text, toxic at all."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy(F.col(id_col).cast("long").alias("of")).agg(
        F.max((toxic & F.coalesce(good, F.lit(False))).cast("int")).alias("toxic_prose"),
        F.max((toxic & ~F.coalesce(good, F.lit(True))).cast("int")).alias("toxic_junk"), F.max(toxic.cast("int")).alias("toxic"))


def score_toxicity(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, threshold: float = 0.3) -> DataFrame:
    """id, a probability p_<category> for each category of ``labelled`` in the order of its columns, and toxic, for each row of docs.

    ``labelled`` has ``of`` (the id) and 0/1 columns, the chain's categories. The chain is fitted on the ``most_labelled``
    labelled documents whose ids hash least; all rows of docs are scored, over the whole text. ``toxic`` is true where the
    last category, which is fed all others, reaches the threshold. A category without positives gets a probability of 0;
    without labels all do.
    Null and empty texts have the intercepts' probabilities; repeated rows are each scored, texts of any length whole.
    """
    spark = docs.sparkSession
    names = [c for c in labelled.columns if c != "of"]
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = chosen.select("id").distinct().join(labelled, F.col("id") == F.col("of")).orderBy(F.xxhash64("of"), "of").limit(most_labelled).select("of", *names)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            x = features(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([r.astype(np.int32).tobytes() for r in np.split(x.columns, x.offsets[1:-1])], pa.binary())], names=["id", "x"])

    # a bounded sample: most_labelled rows of word buckets
    sample = chosen.join(picked.select(F.col("of").alias("id")), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(words, "id long, x binary")
    sample = sample.join(picked, F.col("id") == F.col("of")).orderBy("id").toPandas()
    columns = [np.frombuffer(b, np.int32) for b in sample["x"]]
    x = Sparse(np.concatenate([*columns, np.empty(0, np.int32)]).astype(np.int64), np.r_[0, np.cumsum([len(c) for c in columns])].astype(np.int64))
    chain = fit_chain(x, sample[names].to_numpy(dtype=float).reshape(-1, len(names)), np.arange(len(sample)) % FOLDS)
    given = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            p = given.value(features(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["id"], *map(pa.array, p.T)], names=["id", *names])

    scored = chosen.mapInArrow(run, "id long" + "".join(f", {c} double" for c in names))
    return scored.select(F.col("id").alias(id_col), *[F.col(c).alias(f"p_{c}") for c in names], (F.col(names[-1]) >= threshold).alias("toxic"))
