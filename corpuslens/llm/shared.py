"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.stored import materialise, shared_folder, shared_path  # noqa: F401  for the modules beside this one

#: Everything that is neither letter, mark nor number separates words.
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"
NO_LETTER = r"[^\p{L}\p{M}]+"


def held_out(id_col: str):
    """True for the fifth of the rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@contextlib.contextmanager
def bytes_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """Bounds what the jobs that run meanwhile hand to a task's Python at once, in the JVM and there: record batches of so many bytes, or of one row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches between rows so that each slice has about ``most`` bytes of text; a longer row stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(np.maximum(size, most >> 18), dtype=np.int64) // most  # and at most 2^18 rows
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(at, end - at)
            pa.default_memory_pool().release_unused()  # a worker shares its executor's memory with others


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Joins record batches until each has so many rows at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _spaced(texts: pa.Array, digits: bool) -> pa.Array:
    """The texts, lower-cased, with a space for each ASCII character that can't be in a word."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    table = np.full(128, 0x20, np.uint8)
    for lo, hi in (("a", "z"), ("A", "Z"), ("0", "9") if digits else ("a", "a")):
        table[ord(lo) : ord(hi) + 1] = np.arange(ord(lo), ord(hi) + 1)
    if not len(low) or low.buffers()[2] is None:
        return low
    table = np.r_[table, np.arange(0x80, 0x100, dtype=np.uint8)]
    return pa.StringArray.from_buffers(len(low), low.buffers()[1], pa.py_buffer(table[np.frombuffer(low.buffers()[2], np.uint8)]), None, 0, low.offset)


def text_words(texts: pa.Array, digits: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The lower-cased words of each text: a code per word, the distinct words, and each text's offsets into the codes.

    Words are runs of letters, marks and, with ``digits``, numbers. Null counts as empty. Bytes decide for ASCII; of the
    distinct words, those with other characters that part words are split again.
    """
    lists = pc.ascii_split_whitespace(_spaced(texts, digits))
    coded = pc.dictionary_encode(lists.flatten())
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    offsets = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)]
    separator = NO_WORD if digits else NO_LETTER
    mixed = pc.match_substring_regex(words, separator).to_numpy(zero_copy_only=False) | (pc.binary_length(words).to_numpy(zero_copy_only=False) == 0)
    if mixed.any():
        parts = pc.split_pattern_regex(words, separator)
        many = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        again = pc.dictionary_encode(parts.flatten())
        first, part = np.cumsum(many) - many, again.indices.to_numpy(zero_copy_only=False)
        n = many[codes]
        ends = np.r_[0, np.cumsum(n)]
        codes = part[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])]
        words, offsets = again.dictionary, ends[offsets]
        empty = pc.index(words, "").as_py()
        if empty >= 0:
            keep = codes != empty
            offsets = np.r_[0, np.cumsum(keep, dtype=np.int64)][offsets]
            codes = codes[keep]
    return codes, words, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants, which are fixed values)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same in every task."""
    if not len(words):
        return np.empty(0, np.uint64)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.r_[np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)]
    length = np.diff(at)
    out = mix64(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for eights in np.unique(-(-length // 8)):
        rows = np.flatnonzero(-(-length // 8) == eights)
        for i in range(eights):
            place = at[rows, None] + np.arange(8 * i, 8 * i + 8)
            bytes_ = np.where(place < at[rows + 1, None], raw[np.minimum(place, len(raw) - 1)], 0).astype(np.uint8)
            out[rows] = mix64(out[rows] ^ bytes_.view("<u8")[:, 0])
    return out


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each item of a ragged array."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def total(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row of a ragged array."""
    sums = np.r_[counts.dtype.type(0), np.cumsum(counts, dtype=counts.dtype)]
    return sums[offsets[1:]] - sums[offsets[:-1]]
