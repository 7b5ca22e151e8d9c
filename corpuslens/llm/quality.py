"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, materialise, rows_of, slices, text_words, total

#: Of a byte: what it is to the statistics. Bytes from 0x80 on are parts of letters as a rule.
UPPER, LOWER, HIGH, DIGIT, SPACE, LINE, STOP, MARK = range(8)
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:], _CLASS[0x30:0x3A] = UPPER, LOWER, HIGH, DIGIT
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _CLASS[0x0A], _CLASS[[ord(c) for c in ".,;:?'\"-()"]] = SPACE, LINE, STOP
STATISTICS = ("log_bytes", "log_words", "upper", "high", "digit", "space", "line", "stop", "mark", "word_length", "distinct", "log_distinct_rate", "same_as_last", "top_word", "long_words", "letter_entropy")


def document_statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text, over the whole of it. Null or empty: zeros, but for shares of nothing, which are 0 too."""
    texts = texts.fill_null("")
    n_docs = len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(size)]
    raw = np.frombuffer(b"".join(x.as_buffer() for x in texts), np.uint8)
    kinds = _CLASS[raw]
    share = np.stack([total((kinds == k).astype(np.int64), ends) for k in range(8)], axis=1) / np.maximum(size, 1)[:, None]
    codes, words, offsets = text_words(texts)
    n_words = np.diff(offsets)
    some = np.maximum(n_words, 1)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = length[codes]
    pair, times = np.unique(rows_of(offsets) * max(1, len(words)) + codes, return_counts=True)
    rows = pair // max(1, len(words))
    bounds = np.searchsorted(rows, np.arange(n_docs + 1))
    distinct = np.diff(bounds)
    top = np.zeros(n_docs)
    np.maximum.at(top, rows, times)
    p = times / some[rows]
    entropy = total(-p * np.log(p), bounds)
    same = np.r_[False, codes[1:] == codes[:-1]].astype(np.int64)
    same[offsets[:-1][n_words > 0]] = 0
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), share[:, UPPER], share[:, HIGH], share[:, DIGIT], share[:, SPACE], share[:, LINE], share[:, STOP], share[:, MARK],
        total(lengths, offsets) / some, distinct / some, np.log1p(distinct) / np.log(some + 2), total(same, offsets) / some, top / some,
        total((lengths > 15).astype(np.int64), offsets) / some, entropy / np.log(some + 2),
    ])


@dataclass(frozen=True)
class Features:
    """cos(x W + b) for standardised statistics x: an approximation of the Gaussian kernel exp(-|x-y|^2 / 2 width^2)."""

    mean: np.ndarray
    scale: np.ndarray
    width: float = 2.0
    size: int = 192
    seed: int = 9

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        w, b = rng.normal(size=(x.shape[1], self.size)) / self.width, rng.uniform(0, 2 * np.pi, self.size)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / self.size) * np.cos(z @ w + b)])


@dataclass(frozen=True)
class QualityModel:
    features: Features
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.knots, self.values)


def _matrix(rows: pa.ListArray) -> np.ndarray:
    return rows.flatten().to_numpy().reshape(-1, len(STATISTICS))


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id and the statistics (array<double>) of each row of docs, and the columns to carry, the i-th of them as __c<i>."""
    kinds = {f"__c{i}": docs.schema[c].dataType.simpleString() for i, c in enumerate(carry)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(list(document_statistics(batch["text"])), pa.list_(pa.float64())), *[batch[c] for c in kinds]], names=["id", "x", *kinds])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(k) for c, k in zip(carry, kinds, strict=True)])
    return chosen.mapInArrow(run, "id long, x array<double>" + "".join(f", {c} {t}" for c, t in kinds.items()))


def isotonic(at: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points at (ascending) that stand for n rows, of which some are positive: knots and values."""
    blocks: list[list[float]] = []
    for x, m, p in zip(at, n, positive, strict=True):
        blocks.append([x * m, m, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # half a row of either kind keeps the ends off 0 and 1
    return np.array([b[0] / b[1] for b in blocks]), np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks])


def fit(train: DataFrame, *, ridge: float = 1e-3, size: int = 192, bins: int = 2000) -> QualityModel | None:
    """Fits on all rows (x array<double>, y double) of train; None if it has no rows.

    Each task sums its part of the normal equations; they meet by matrix row, and the driver solves a system of size + 1
    unknowns. For the calibration each task counts its rows by rounded raw score, in at most ``bins`` bins.
    """
    stats = train.select(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(STATISTICS))], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(len(STATISTICS))], F.count("*").alias("n")).first()
    if not stats["n"]:
        return None
    mean = np.array([stats[f"m{i}"] for i in range(len(STATISTICS))])
    features = Features(mean, np.maximum([stats[f"s{i}"] for i in range(len(STATISTICS))], 1e-6), size=size)
    d = size + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d + 1))
        for batch in batches:
            z = features(_matrix(batch["x"]))
            gram += z.T @ np.column_stack([z, batch["y"].to_numpy()])
        if gram.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d, dtype=np.int32), d + 1)), pa.array(np.tile(np.arange(d + 1, dtype=np.int32), d)), pa.array(gram.ravel())], names=["i", "j", "v"])

    gram = np.zeros((d, d + 1))
    summed = train.select("x", "y").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    gram[summed["i"], summed["j"]] = summed["v"]
    penalty = ridge * stats["n"] * np.diag(np.r_[0, np.ones(size)]) / size
    weights = np.linalg.solve(gram[:, :d] + penalty + 1e-9 * np.eye(d), gram[:, d])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, positive = np.zeros(bins + 1), np.zeros(bins + 1)
        for batch in batches:
            at = np.rint(np.clip((features(_matrix(batch["x"])) @ weights + 1) / 3, 0, 1) * bins).astype(int)
            n += np.bincount(at, minlength=bins + 1)
            positive += np.bincount(at, batch["y"].to_numpy(), minlength=bins + 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(positive[some])], names=["b", "n", "p"])

    found = train.select("x", "y").mapInArrow(counts, "b int, n double, p double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toPandas().sort_values("b")
    return QualityModel(features, weights, *isotonic(found["b"].to_numpy() / bins * 3 - 1, found["n"].to_numpy(), found["p"].to_numpy()))


def _learnt(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> QualityModel | None:
    known = labels.select(F.col(id_col).cast("long").alias("of"), F.col(label_col).cast("double").alias("y")).where(F.col("of").isNotNull() & F.col("y").isNotNull() & ~held_out("of"))
    return fit(materialise(stats.join(known.groupBy("of").agg(F.avg("y").alias("y")), F.col("id") == F.col("of")).select("x", "y"), "quality-train"))


def _scores(model: QualityModel | None, batch: pa.RecordBatch) -> np.ndarray:
    return np.clip(model(_matrix(batch["x"])), 0, 1) if model else np.full(batch.num_rows, 0.5)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score and predicted of each row of docs.

    The model learns from all labelled rows that aren't held out, from their statistics alone. Rows of labels that share
    an id count by their mean; null labels and null ids are left out. A null or empty text is scored as an empty text.
    Without a label to learn from, every score is 0.5. Repeated rows are each scored.
    """
    stats = materialise(statistics_table(docs, id_col, text_col), "quality-statistics")
    model = _learnt(stats, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(_scores(model, batch))], names=["id", "score"])

    scored = stats.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score_quality predicts 1 for, with the columns of docs. Each row is judged by its own text, whatever its id."""
    names = docs.columns
    stats = materialise(statistics_table(docs, id_col, text_col, tuple(names)), "quality-statistics")
    model = _learnt(stats, labels, id_col, label_col)
    inner = [f"__c{i}" for i in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch) >= threshold)).select(inner)

    kept = stats.mapInArrow(run, ", ".join(f"{c} {docs.schema[name].dataType.simpleString()}" for c, name in zip(inner, names, strict=True)))
    return kept.select(*[F.col(c).alias(name) for c, name in zip(inner, names, strict=True)])
