"""Token-ID output by plane shuffling.

Documents are tokenised in ascending id order, their ids are cut into fixed-size blocks, each block is transposed into
byte planes (or bit planes) and each plane is compressed with zstandard. A file is a Parquet table of chunks; a chunk row
holds up to ``BLOCKS`` blocks, the sizes of all their planes (the chunk index) and the documents, or parts of documents,
that lie in it, so any chunk can be read alone.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import slices

BLOCK = 1 << 16
BLOCKS = 16
#: At most this many shards; it bounds the table of shard offsets that the reader broadcasts (16 bytes a shard).
MOST_SHARDS = 1 << 16

CHUNK = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("chunk", T.IntegerType()),
    T.StructField("first_id", T.LongType()),
    T.StructField("n_ids", T.IntegerType()),
    T.StructField("first_doc", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.IntegerType())),
    T.StructField("head_split", T.BooleanType()),
    T.StructField("tail_split", T.BooleanType()),
    T.StructField("planes", T.StringType()),
    T.StructField("plane_sizes", T.ArrayType(T.IntegerType())),
    T.StructField("payload", T.BinaryType()),
])
PIECE = "shard int, doc long, chunk int, doc_id long, first_id long, ids binary"


# --- tokenising -------------------------------------------------------------------------------------------------------


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: How a byte-level pre-tokeniser writes the bytes that UTF-8 uses for ASCII and Latin-1 letters: printable Latin-1 bytes
#: stand for themselves, the others follow from U+0100 in ascending order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHAR = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_PLAIN = {c: "".join(_BYTE_CHAR[b] for b in chr(c).encode()) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))}


#: U+00C0 to U+024F but for the signs ×, ÷ and for İ, whose lower case ends with a mark: each is one letter when composed and lower-cased.
LETTERS = r"\x{00c0}-\x{00d6}\x{00d8}-\x{00f6}\x{00f8}-\x{012f}\x{0131}-\x{024f}"


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space and lower-cases, a distinct word at a time.

    White space only separates for such a tokenizer, so a text's ids are those of its white-space-separated words, one
    after another; each distinct word of a slice is encoded once. A word of lower-case ASCII and Latin-1 letters is one
    pre-token, which goes straight to the tokenizer's model; any other goes through the whole tokenizer.
    """

    def __init__(self, path: str, remember: int = 300_000):
        self.tokenizer, self.seen, self.remember = _tokenizer(path), {}, remember

    def _encode(self, word: str) -> bytes:
        low = word.lower()
        if all(ord(c) in _PLAIN for c in low) and all(ord(c) < 0x100 for c in word):
            return array("I", [t.id for t in self.tokenizer.model.tokenize(low.translate(_PLAIN))]).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by end_id, and the number of each."""
        texts = pc.fill_null(texts, "")
        # a run of ASCII marks between a letter and white space is a pre-token of its own; apart, it makes fewer distinct words
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=rf"([a-z0-9{LETTERS}])([!-&(-/:-@\[-`{{-~]+)(\s|$)", replacement=r"\1 \2\3")
        # such marks might belong to the name of a special token, which has them within
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, plain))
        coded = pc.dictionary_encode(lists.flatten())
        seen = self.seen
        table = []
        for word in coded.dictionary.to_pylist():
            if (ids := seen.get(word)) is None:
                ids = self._encode(word) if word else b""
                if len(seen) < self.remember and len(word) < 64:
                    seen[word] = ids
            table.append(ids)
        table.append(array("I", [end_id]).tobytes())
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        first = np.r_[0, np.cumsum(size)[:-1]]
        flat = np.frombuffer(b"".join(table), np.uint32)
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(per_text), len(table) - 1)
        n = size[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.r_[0, np.r_[0, ends][np.cumsum(per_text + 1)]])


# --- planes -----------------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray, planes: str, level: int = 3) -> tuple[list[int], list[bytes]]:
    """One block of ids as compressed planes: 4 byte planes or 32 bit planes, the low one first."""
    import zstandard

    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if planes == "bit":
        raw = np.concatenate([np.packbits(np.unpackbits(b[:, None], axis=1, bitorder="little").T, axis=1, bitorder="little") for b in raw])
    press = zstandard.ZstdCompressor(level=level)
    out = [press.compress(np.ascontiguousarray(p).tobytes()) for p in raw]
    return [len(x) for x in out], out


def unpack(sizes: list[int], payload: memoryview, n: int, planes: str) -> np.ndarray:
    """The block of n ids whose planes follow one another in the payload."""
    import zstandard

    open_, at, raw = zstandard.ZstdDecompressor(), 0, []
    for size in sizes:
        raw.append(np.frombuffer(open_.decompress(payload[at : at + size]), np.uint8))
        at += size
    if planes == "bit":
        raw = [np.packbits(np.stack([np.unpackbits(b, count=n, bitorder="little") for b in raw[i : i + 8]], axis=1), axis=1, bitorder="little")[:, 0] for i in range(0, 32, 8)]
    return np.ascontiguousarray(np.stack(raw, axis=1)).view("<u4")[:, 0]


class _Chunks:
    """Collects the documents of a shard and cuts them into chunk rows."""

    def __init__(self, planes: str):
        self.planes, self.shard, self.chunk, self.first, self.first_doc = planes, None, 0, 0, 0
        self.ids, self.n, self.docs, self.lengths, self.split = [], 0, [], [], False

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[dict]:
        at = 0
        while True:
            take = min(len(ids) - at, BLOCK * BLOCKS - self.n)
            self.ids.append(ids[at : at + take])
            self.docs.append(doc_id)
            self.lengths.append(take)
            self.n += take
            at += take
            if self.n == BLOCK * BLOCKS:
                yield self.row(at < len(ids))
            if at == len(ids):
                return

    def row(self, goes_on: bool) -> dict:
        ids, sizes, parts = np.concatenate(self.ids), [], []
        for i in range(0, len(ids), BLOCK):
            s, p = pack(ids[i : i + BLOCK], self.planes)
            sizes += s
            parts += p
        out = {"shard": self.shard, "chunk": self.chunk, "first_id": self.first, "n_ids": len(ids), "first_doc": self.first_doc, "doc_ids": self.docs, "lengths": self.lengths, "head_split": self.split, "tail_split": goes_on, "planes": self.planes, "plane_sizes": sizes, "payload": b"".join(parts)}
        self.chunk, self.first, self.first_doc = self.chunk + 1, self.first + len(ids), self.first_doc + len(self.docs) - goes_on
        self.ids, self.n, self.docs, self.lengths, self.split = [], 0, [], [], goes_on
        return out


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, planes: str = "byte", shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenises docs and writes their ids below path, in ascending order of id.

    Ties of the id (repeated rows) are ordered by a hash of the text; a null id comes first; a null text is empty and so
    has the end id only; an empty table gives a file without chunks. Documents are range-partitioned before they are
    tokenised, because text is smaller than its ids; a document may span chunks, never shards.
    """
    if planes not in ("byte", "bit"):
        raise ValueError(f"planes: {planes}")
    spark = docs.sparkSession
    shards = min(MOST_SHARDS, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards, "id", "tie")
        .sortWithinPartitions("id", "tie")
        .select(F.spark_partition_id().alias("shard"), "id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, words, chunks, done = to_arrow_schema(CHUNK), WordEncoder(tokenizer), _Chunks(planes), []
        for batch in slices(batches, "text", 4 << 20):
            ids, n = words(batch["text"], end_id)
            if chunks.shard is None:
                chunks.shard = batch["shard"][0].as_py()
            for doc_id, one in zip(batch["id"].to_pylist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                done += chunks.add(doc_id, one)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if chunks.n:
            yield pa.RecordBatch.from_pylist([chunks.row(False)], schema=schema)

    ordered.mapInArrow(encode, CHUNK).write.option("compression", "uncompressed").parquet(path)


def _pieces(batches: Iterator[pa.RecordBatch], split: bool) -> Iterator[pa.RecordBatch]:
    """The documents that lie in one chunk, or the parts of those that span chunks."""
    schema = pa.schema([("shard", pa.int32()), ("doc", pa.int64()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("first_id", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            length = np.array(row["lengths"], np.int64)
            ends = np.cumsum(length)
            parts = np.zeros(len(length), bool)
            parts[0], parts[-1] = row["head_split"], row["tail_split"] or parts[-1] if len(parts) > 1 else row["head_split"] or row["tail_split"]
            want = np.flatnonzero(parts == split)
            if not len(want):
                continue
            per, n = (32 if row["planes"] == "bit" else 4), row["n_ids"]
            needed = np.unique(np.concatenate([np.arange((ends[i] - length[i]) // BLOCK, (ends[i] - 1) // BLOCK + 1) for i in want])) if split else range(-(-n // BLOCK))
            at, ids = np.r_[0, np.cumsum(row["plane_sizes"])], np.zeros(n, "<u4")
            for b in needed:
                lo, hi = b * BLOCK, min(n, (b + 1) * BLOCK)
                ids[lo:hi] = unpack(row["plane_sizes"][b * per : (b + 1) * per], memoryview(row["payload"])[at[b * per] :], hi - lo, row["planes"])
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(want), row["shard"], np.int32)),
                pa.array(row["first_doc"] + want),
                pa.array(np.full(len(want), row["chunk"], np.int32)),
                pa.array([row["doc_ids"][i] for i in want], pa.int64()),
                pa.array(row["first_id"] + ends[want] - length[want]),
                pa.array([raw[4 * (ends[i] - length[i]) : 4 * ends[i]] for i in want], pa.binary()),
            ], schema=schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document below path.

    Documents within one chunk come from its own row without a shuffle; only the parts of those that span chunks meet by document.
    """
    chunks = spark.read.schema(CHUNK).parquet(path)
    base = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        F.col("shard").alias("of_shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    whole = chunks.mapInArrow(lambda b: _pieces(b, False), PIECE).select("shard", "doc_id", "first_id", "ids")
    parts = chunks.where("head_split or tail_split").mapInArrow(lambda b: _pieces(b, True), PIECE)
    joined = (
        parts.groupBy("shard", "doc")
        .agg(F.first("doc_id").alias("doc_id"), F.min("first_id").alias("first_id"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
        .select("shard", "doc_id", "first_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
    )
    # the shard offsets are broadcast: MOST_SHARDS rows at most
    return whole.unionByName(joined).join(F.broadcast(base), F.col("shard") == F.col("of_shard")).select(
        "doc_id", (F.col("base") + F.col("first_id")).cast("long").alias("start"), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids of each document below path."""
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
