"""Importance resampling towards a target distribution of hashed words, by external sort-count.

Each slice of documents becomes one row of a table: the buckets of its features as a packed stream of 16-bit numbers, the
documents' offsets into it, and the stream sorted and run-length encoded. The runs of all slices add up to the counts of
the corpus; those against the target's counts give a gain for each bucket; the streams are then read once more and a
document's weight is the sum of the gains of its buckets, gathered with ``np.add.reduceat``.

A null text has no words. A null id is an id of its own (hashed as an empty one), after all others in ties. Repeated rows
each count and are each drawn or not. Empty tables give no rows, or gains against nothing. Words and texts of any length
are whole; a text longer than a slice is a row of its own. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.ordered import numbered

from .shared import materialise, record, rows_of, slices

#: A bucket's number has 16 bits; this also bounds what is gathered for the gains and sent to the tasks.
MOST_BUCKETS = 1 << 16
STREAM = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("features", pa.list_(pa.int64())), ("stream", pa.binary()), ("run_bucket", pa.list_(pa.int32())), ("run_length", pa.list_(pa.int64()))])
_STREAM_SQL = "ids array<bigint>, words array<bigint>, features array<bigint>, stream binary, run_bucket array<int>, run_length array<bigint>"

#: What each byte becomes: A-Z lower-cased, a-z, 0-9 and bytes of other than ASCII characters as they are, all else a space.
_BYTES = np.full(256, 0x20, np.uint8)
for _lo, _hi, _to in ((0x30, 0x39, 0x30), (0x41, 0x5A, 0x61), (0x61, 0x7A, 0x61), (0x80, 0xFF, 0x80)):
    _BYTES[_lo : _hi + 1] = np.arange(_hi - _lo + 1) + _to


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A code for each word, the distinct words, and the texts' offsets into the codes."""
    texts = pc.fill_null(texts, "").combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.fill_null(texts, "")
    if not len(texts):
        return np.empty(0, np.int64), [], np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = _BYTES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    inside = raw != 0x20
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[(first := at[:-1] - at[0])[first < len(raw)]] |= inside[first[first < len(raw)]]  # a text's first byte begins a word
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # a word each, without what lies between
    lengths = stops - starts
    flat = raw[inside]
    coded = pc.dictionary_encode(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.py_buffer(flat)]))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(starts, at - at[0])


def feature_buckets(texts: pa.Array, most_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, text by text; the numbers of features and of words of each text.

    Features are all runs of 1 to ``most_words`` words, joined by a space. Only distinct runs are hashed.
    """
    codes, words, offsets = ascii_words(texts)
    n_words = np.diff(offsets)
    hashed = lambda values: np.fromiter(map(zlib.crc32, values), np.uint64, len(values)) % np.uint64(buckets)
    found, text_of = [hashed(words).astype(np.uint16)[codes]] if len(codes) else [np.empty(0, np.uint16)], [rows_of(offsets)]
    runs, strings = codes, words
    for n in range(2, most_words + 1):
        if len(codes) < n:
            break
        pairs, runs = np.unique(runs[: len(codes) - n + 1] * len(words) + codes[n - 1 :], return_inverse=True)
        strings = [strings[a] + b" " + words[b] for a, b in zip(*np.divmod(pairs, len(words)), strict=True)]
        whole = text_of[0][: len(runs)] == text_of[0][n - 1 :]
        found.append(hashed(strings).astype(np.uint16)[runs][whole])
        text_of.append(text_of[0][: len(runs)][whole])
    if len(found) == 1:
        return found[0], n_words, n_words
    rows = np.concatenate(text_of)
    return np.concatenate(found)[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(n_words)), n_words


def sort_count(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a stream, sorted and run-length encoded."""
    ordered = np.sort(stream, kind="stable")  # a radix sort, for 16 bits
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    return ordered[starts].astype(np.int32), np.diff(np.r_[starts, len(ordered)])


def bucket_streams(docs: DataFrame, *, most_words: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each slice: the ids, words and features of its documents, the packed stream and its sorted runs."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets: {buckets}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            stream, n, n_words = feature_buckets(batch["text"], most_words, buckets)
            bucket, length = sort_count(stream)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((batch["id"].to_pylist(), n_words, n, stream.tobytes(), bucket, length), STREAM, strict=True)], schema=STREAM)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(write, _STREAM_SQL)


def bucket_counts(streams: DataFrame) -> DataFrame:
    """bucket and n: the runs of all slices, added up. A bucket has one run a slice at most, and Spark adds those of a task before it shuffles."""
    return streams.select(F.explode(F.arrays_zip("run_bucket", "run_length")).alias("r")).groupBy(F.col("r.run_bucket").alias("bucket")).agg(F.sum("r.run_length").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) for each bucket; as many numbers as buckets are gathered."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for of, counts in ((s, corpus), (t, target)):
        for row in counts.collect():
            of[row.bucket] = row.n
    all_s, all_t = s.sum() + buckets, t.sum() + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document of the streams."""
    shared = streams.sparkSession.sparkContext.broadcast(gains)  # MOST_BUCKETS numbers at most

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch["features"][i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(n) - n
                weight = np.zeros(len(n), np.int64)
                if (some := n > 0).any():
                    weight[some] = np.add.reduceat(shared.value[np.frombuffer(batch["stream"][i].as_buffer(), np.uint16)], first[some])
                yield record(schema, batch["ids"][i].values, batch["words"][i].values, n, weight)

    return streams.select("ids", "words", "features", "stream").mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(seed:doc_id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, most_words: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document: the drawn ones are ranked 1, 2, 3, ..., others have null.

    Of the N documents of ``least_words`` words, floor(percent N / 100) are drawn by the highest sums of weight and a
    Gumbel number that depends on the seed and the id alone, ties to the smaller id: a draw without replacement in
    proportion to the importance weights. Ranks are dealt in ranges of the score, so no task holds them all.
    """
    streams = materialise(bucket_streams(docs, most_words=most_words, buckets=buckets, id_col=id_col, text_col=text_col), "streams")
    wanted = bucket_streams(target.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text")), most_words=most_words, buckets=buckets, id_col="id", text_col="text")
    gains = bucket_gains(bucket_counts(streams), bucket_counts(wanted), buckets)
    scored = weights(streams, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    enough = F.col("n_words") >= least_words
    order = [F.when(enough, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = numbered(scored, order, "__place")
    drawn = streams.select(F.explode("words").alias("n_words")).agg(F.floor(F.count(F.when(enough, 1)) * percent / 100).alias("__drawn"))
    rank = F.when(enough & (F.col("__place") < F.col("__drawn")), F.col("__place") + 1)
    return placed.crossJoin(F.broadcast(drawn)).select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))  # drawn is one row
