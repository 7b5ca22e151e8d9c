"""Alignment of two tokenizers over the bytes of the same texts, a whole Arrow batch at a time.

A batch is laid end to end, with the byte offset of each document. The ends of all tokens of both tokenizers are counted
once by byte (``np.bincount``); a group ends where tokens of both do, and a link (a pair of tokens that share bytes) ends
where a token of either does. Prefix sums over those places, taken at the documents' offsets, give each document's numbers.

What links count over the whole corpus needs a second pass: a batch is one row of a stored table, with its distinct id
pairs, how often it has each, and a small code for each link; Spark adds up the pairs, finds the highest of each B id,
brings a batch's pairs their counts, and the links are looked up by code.

A text that is null, empty or not the same bytes after either tokenizer has no tokens. A null id is kept, repeated rows
count each, an empty table gives no rows, texts and words of any length are whole. Columns but id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise, record, slices

SPACE = "▁"
#: Bytes of text in a batch, and chunks whose tokens a worker remembers from batch to batch.
BATCH, REMEMBERED = 1 << 20, 150_000
DIGESTS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
BATCHES = pa.schema([("batch", pa.int64()), *((n, pa.list_(t)) for n, t in DIGESTS), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("links", pa.binary())])
_BATCHES_SQL = "batch long, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, pairs array<bigint>, counts array<bigint>, links binary"
ALIGNED = pa.schema([*DIGESTS[:-1], ("n_best", pa.int64()), ("count_sum", pa.int64()), DIGESTS[-1]])


#: Which byte a byte-level pre-tokeniser writes with each character: printable Latin-1 for itself, the rest from U+0100 on.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _OWN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in _OWN)}


#: How a byte-level tokenizer of this kind cuts a text before it merges bytes.
_CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose kind is the same in every edition of Unicode, in a chunk that doesn't end with white space.
_SETTLED = re.compile(r"[\x00-\u036f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u4e00-\u9fa5\uac00-\ud7a3]*(?<!\s)")


class Ragged:
    """Rows of small numbers, end to end."""

    def __init__(self, size: np.ndarray, flat: np.ndarray):
        self.size, self.flat = size.astype(np.int32), flat.astype(np.int32)

    @staticmethod
    def of(rows: list[list[int]]) -> Ragged:
        size = np.fromiter(map(len, rows), np.int32, len(rows))
        return Ragged(size, np.fromiter(chain.from_iterable(rows), np.int32, int(size.sum())))

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.r_[self.size, other.size], np.r_[self.flat, other.flat])

    def head(self, n: int) -> Ragged:
        return Ragged(self.size[:n], self.flat[: int(self.size[:n].sum())])

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The numbers of these rows, end to end."""
        n = self.size[rows].astype(np.int64)
        ends = np.cumsum(n)
        first = np.cumsum(self.size, dtype=np.int64) - self.size
        return self.flat[np.repeat(first[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int64)

    def spells(self, raw: list[bytes], names: list[bytes]) -> np.ndarray:
        """Whether the names of each row's numbers are its bytes: all at once, or row by row where they are not."""
        of = names.__getitem__
        if b"".join(map(of, self.flat.tolist())) == b"".join(raw):
            sizes = np.fromiter(map(len, names), np.int64, len(names))[self.flat]
            ends = np.r_[0, np.cumsum(sizes)][np.cumsum(self.size, dtype=np.int64)]
            if (ends == np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))).all():
                return np.ones(len(raw), bool)
        rows = np.split(self.flat, np.cumsum(self.size)[:-1])
        return np.fromiter((b"".join(map(of, row.tolist())) == x for row, x in zip(rows, raw, strict=True)), bool, len(raw))


class Encoders:
    """Both tokenizers, and the bytes of each of their tokens.

    Neither makes a token across a space that follows a character that is no white space, so texts are cut there and each
    distinct chunk is encoded once in a batch, A with its space, B without, which adds one itself. Where A merges in order
    of id and a chunk's characters are settled, many chunks go end to end through a faster library with A's vocabulary.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        self.path_a, self._slow = path_a, None
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: name for name, i in (spec["model"]["vocab"] | special).items()}
        if sorted(names) != list(range(len(names))):
            raise ValueError(f"{path_a}: ids have gaps")
        self.bytes_a = [bytes(_BYTE_OF.get(c, 0) for c in names[i]) for i in range(len(names))]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = spec["model"]["vocab"]
        known = [*_BYTE_OF, *("".join(m) for m in merges)]
        cuts = spec["pre_tokenizer"]
        in_order = spec["normalizer"] is None and cuts["type"] == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"] and not spec["model"]["ignore_merges"] and len(known) == len(ids) and all(ids[m] == 256 + i for i, m in enumerate(known[256:]))
        self.fast = tiktoken.Encoding("a", pat_str=_CUTS, mergeable_ranks={self.bytes_a[i]: i for i in ids.values()}, special_tokens={}) if in_order else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace(SPACE, " ").encode() for i in range(self.b.vocab_size())]
        self.size_a, self.size_b = (np.fromiter(map(len, table), np.int64, len(table)) for table in (self.bytes_a, self.bytes_b))
        self.lone = self.b.piece_to_id(SPACE)
        self.seen: dict[str, int] = {}
        self.tokens_a, self.tokens_b, self.same = Ragged.of([]), Ragged.of([]), np.empty(0, bool)

    def _encode_a(self, chunks: list[str], raw: list[bytes]) -> Ragged:
        settled = np.fromiter((self.fast is not None and _SETTLED.fullmatch(c) is not None for c in chunks), bool, len(chunks))
        order = np.argsort(~settled, kind="stable")
        n = int(settled.sum())
        flat = np.array(self.fast.encode_ordinary("".join(chunks[i] for i in order[:n])) if n else [], np.int32)
        ends = np.searchsorted(np.cumsum(self.size_a[flat]), np.cumsum([len(raw[i]) for i in order[:n]])) + 1
        both = Ragged(np.diff(np.r_[0, ends]), flat)
        if n < len(chunks):
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self.path_a)
                self._slow.encode_special_tokens = True
            both += Ragged.of([e.ids for e in self._slow.encode_batch_fast([chunks[i] for i in order[n:]], add_special_tokens=False)])
        back = np.argsort(order)
        return Ragged(both.size[back], both.take(back))

    def encode(self, chunks: list[str]) -> tuple[Ragged, Ragged, np.ndarray]:
        """Ids of A and of B of each chunk, and whether both have its bytes."""
        a, b, same = Ragged.of([]), Ragged.of([]), []
        for lo in range(0, len(chunks), 8192):  # the libraries' own results take much memory
            part = chunks[lo : lo + 8192]
            raw = [c.encode() for c in part]
            ids_b = self.b.encode([c[1:] for c in part], num_threads=1)
            for i in [i for i, c in enumerate(part) if c == " "]:
                ids_b[i] = [self.lone]
            one, two = self._encode_a(part, raw), Ragged.of(ids_b)
            same.append(one.spells(raw, self.bytes_a) & two.spells(raw, self.bytes_b))
            a, b = a + one, b + two
        return a, b, np.concatenate([np.empty(0, bool), *same])

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, Ragged, Ragged, np.ndarray]:
        """The row of each chunk in the tables of tokens of A, of B and of whether both have its bytes."""
        known = len(self.seen)
        new = sorted((c for c in chunks if c not in self.seen), key=lambda c: len(c) > 64)  # short ones first: these are remembered
        at = {c: known + i for i, c in enumerate(new)}
        rows = np.fromiter((self.seen[c] if c in self.seen else at[c] for c in chunks), np.int64, len(chunks))
        a, b, same = self.encode(new)
        tables = self.tokens_a + a, self.tokens_b + b, np.r_[self.same, same]
        more = min(REMEMBERED - known, sum(len(c) <= 64 for c in new))
        if more > 0:
            self.seen.update((c, known + i) for i, c in enumerate(new[:more]))
            self.tokens_a, self.tokens_b, self.same = tables[0].head(known + more), tables[1].head(known + more), tables[2][: known + more]
        return rows, *tables


@lru_cache(1)
def _encoders(path_a: str, path_b: str) -> Encoders:
    return Encoders(path_a, path_b)


def _after_white_space(raw: np.ndarray) -> np.ndarray:
    """Whether the character before each byte is white space of any kind."""
    one, two, three = (np.r_[np.zeros(i, np.uint8), raw[:-i] if len(raw) >= i else raw[:0]][: len(raw)] for i in (1, 2, 3))
    ascii_ = (one == 0x20) | (one >= 0x09) & (one <= 0x0D) | (one >= 0x1C) & (one <= 0x1F)
    latin = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    general = (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) | (two == 0x81) & (one == 0x9F))
    return ascii_ | latin | general | (three == 0xE1) & ((two == 0x9A) & (one == 0x80) | (two == 0xA0) & (one == 0x8E)) | (three == 0xE3) & (two == 0x80) & (one == 0x80)


def chunks(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """A code for each chunk of space+text, the distinct chunks, and the texts' offsets into the codes; an empty text has none."""
    spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    at = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1].astype(np.int64)
    whole = spaced.buffers()[2] or pa.py_buffer(b"")
    raw = np.frombuffer(whole, np.uint8)[at[0] : at[-1]]
    begins = (raw == 0x20) & ~_after_white_space(raw)
    begins[(at[:-1] - at[0])[np.diff(at) > 0]] = True
    starts = np.flatnonzero(begins) + at[0]
    coded = pc.dictionary_encode(pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, at[-1]].astype(np.int32)), whole))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(starts, at)


class Aligned:
    """Tokens a and b (ids and byte lengths) of a batch of documents that end at the bytes ``doc_ends``.

    n_a, n_b, n_groups, n_links: of each document. link_a, link_b: the ids of each link. ends: where each document's links end.
    """

    def __init__(self, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, doc_ends: np.ndarray):
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        total = int(doc_ends[-1]) if len(doc_ends) else 0
        # 1 where a token of a ends, 2 where one of b, 3 where both do
        ended = np.bincount(np.r_[ends_a, ends_b, ends_b], minlength=total + 1)
        place = np.flatnonzero(ended)
        ended = ended[place]
        is_a, is_b, cut = ended & 1, ended >> 1, (ended == 3).astype(np.int64)
        before = lambda marks: np.r_[0, np.cumsum(marks)]
        self._a, self._b, self._groups = before(is_a), before(is_b), before(cut)
        self.ends = np.searchsorted(place, doc_ends, "right")
        self.n_links = np.diff(np.r_[0, self.ends])
        self.n_a, self.n_b, self.n_groups = (np.diff(np.r_[0, sums[self.ends]]) for sums in (self._a, self._b, self._groups))
        self.a, self.b = a, b
        self.link_a, self.link_b = a[self._a[:-1]], b[self._b[:-1]]
        self.group_a, self.group_b = self._groups[:-1][is_a > 0], self._groups[:-1][is_b > 0]

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """All groups as bytes, ``a1,a2|b1;`` and so on, and the end of each document among them."""
        n = len(self.a) + len(self.b)
        groups = int(self._groups[-1])
        many_a, many_b = (np.bincount(g, minlength=groups) for g in (self.group_a, self.group_b))
        upto_a, upto_b = np.cumsum(many_a), np.cumsum(many_b)
        at_a = np.arange(len(self.a)) + (upto_b - many_b)[self.group_a]
        at_b = np.arange(len(self.b)) + upto_a[self.group_b]
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[upto_a - 1 + upto_b - many_b], mark[upto_a + upto_b - 1] = ord("|"), ord(";")
        width = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
        ends = np.cumsum(width + 1)
        text = np.empty(ends[-1] if n else 0, np.uint8)
        text[ends - 1] = mark
        for k in range(int(width.max()) if n else 0):
            has = width > k
            text[ends[has] - 2 - k] = ord("0") + ids[has] // 10**k % 10
        return text, np.r_[0, ends][np.cumsum(self.n_a) + np.cumsum(self.n_b)]


def encoded_batch(encoders: Encoders, texts: pa.Array) -> Aligned:
    """The alignment of the texts of a batch; those that have no tokens are as if they were empty."""
    texts = pc.fill_null(texts, "")
    codes, distinct, offsets = chunks(texts)
    rows, tokens_a, tokens_b, same = encoders(distinct)
    codes = rows[codes]
    wrong = np.diff(np.r_[0, np.cumsum(~same[codes])][offsets]) > 0
    codes = codes[np.repeat(~wrong, np.diff(offsets))]
    a, b = tokens_a.take(codes), tokens_b.take(codes)
    length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    doc_ends = np.cumsum(np.where(wrong | (length == 0), 0, length + 1))
    return Aligned(a, encoders.size_a[a], b, encoders.size_b[b], doc_ends)


def _coded(links: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The distinct pairs, commonest first, how often each comes, and each link's place among them, in two bytes if they suffice, packed."""
    coded = pc.dictionary_encode(pa.array(links))
    codes, pairs = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False)
    counts = np.bincount(codes, minlength=len(pairs))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), "<u2" if len(order) <= 1 << 16 else "<u4")
    place[order] = np.arange(len(order))
    return pairs[order], counts[order], zstandard.ZstdCompressor(level=1).compress(place[codes].tobytes())


def _unpacked(links: bytes, n_pairs: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(links), "<u2" if n_pairs <= 1 << 16 else "<u4")


def aligned_batches(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each batch: its documents' numbers and digests, its id pairs (a * 2^32 + b) with counts, and the links' packed codes."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, number = _encoders(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BATCH):
            found = encoded_batch(encoders, batch["text"])
            text, ends = found.written()
            digests = [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            pairs, counts, links = _coded(found.link_a << 32 | found.link_b)
            row = (number, batch["id"].to_pylist(), found.n_a, found.n_b, found.n_groups, found.n_links, digests, pairs, counts, links)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BATCHES, strict=True)], schema=BATCHES)
            number += 1

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(align, _BATCHES_SQL)


def pair_counts(batches: DataFrame) -> DataFrame:
    """a, b and count of all linked id pairs, and best: whether no other pair of that b counts more. A batch has a pair once, and a b as many rows as A has ids at most."""
    each = batches.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    ids = each.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "count")
    return ids.select("pair", "a", "b", "count", (F.max("count").over(Window.partitionBy("b")) == F.col("count")).alias("best"))


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            n_links = batch["n_links"][i].values.to_numpy(zero_copy_only=False)
            known = len(batch["codes"][i]) if batch["codes"][i].is_valid else 0
            codes = _unpacked(batch["links"][i].as_buffer(), known)
            count, best = np.zeros(known, np.int64), np.zeros(known, np.int64)
            if known:
                at = batch["codes"][i].values.to_numpy(zero_copy_only=False)
                count[at] = batch["count"][i].values.to_numpy(zero_copy_only=False)
                best[at] = batch["best"][i].values.to_numpy(zero_copy_only=False)
            ends = np.cumsum(n_links)
            per_doc = [np.diff(np.r_[0, np.r_[0, np.cumsum(x[codes])][ends]]) for x in (best, count)]
            own = [batch[n][i].values for n, _ in DIGESTS]
            yield record(ALIGNED, *own[:-1], *per_doc, own[-1])


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    n_best: links of a pair that counts as much as any of its B id does in the corpus; count_sum: the sum of the pairs' counts.
    """
    batches = materialise(aligned_batches(docs, path_a, path_b, id_col, text_col), "aligned")
    counts = pair_counts(batches).select("pair", "count", "best")
    own = batches.select("batch", F.posexplode("pairs").alias("code", "pair"))
    brought = own.join(counts, "pair").groupBy("batch").agg(F.collect_list("code").alias("codes"), F.collect_list("count").alias("count"), F.collect_list("best").alias("best"))
    whole = batches.drop("pairs", "counts").join(brought, "batch", "left")
    return whole.select(*[n for n, _ in DIGESTS], "links", "codes", "count", "best").mapInArrow(_looked_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
