"""Benchmark decontamination by spaced seeds.

A seed is a mask over a few neighbouring words; words under a 0 may differ. The hashes of all masked windows of the
benchmark are looked up for every window of the training texts, and around each hit the two texts are compared word by
word, so that an overlap is found with substituted words in it. Every overlap has a hit (see MASKS and short_masks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NO_WORD, materialise, mix64, slices, text_words, word_hashes

#: An overlap counts with this many words, or all words of a shorter item, of which this share is equal.
LEAST_WORDS, SIMILARITY = 13, 0.8
#: An overlap of 13 words or more falls into pieces of 13 to 25 words, one of which has 80 % of its words equal too. With m
#: substitutions that piece has a run of (n - m) / (m + 1) equal words, which is above 3 and so at least 4 but for 15 words in
#: four runs of three: those have the second mask.
MASKS = ("1111", "1110111")
#: So many hits of a mask are compared at once.
HITS = 1 << 16
#: A benchmark of more words than this is taken in parts, each of which is broadcast: 20 bytes a word.
PART_WORDS = 4_000_000


def _window_hashes(words: np.ndarray, mask: str, seed: int) -> np.ndarray:
    """The masked hash of each window of the word hashes."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                out += words[i : i + n] * (mix64(np.uint64(1000 * seed + i)) | np.uint64(1))
    return mix64(out)


def short_masks(length: int) -> list[str]:
    """Masks of which each overlap with all of an item of fewer than LEAST_WORDS words has one.

    Its first and last words are equal, and of one part more than it may have substitutions one part is free of them.
    """
    most = int(length * (1 - SIMILARITY) + 1e-9)
    if not most:
        return ["1" * length]
    parts = np.array_split(np.arange(1, length - 1), most + 1)
    return ["".join("1" if i in (0, length - 1, *part) else "0" for i in range(length)) for part in parts]


class Benchmark:
    """The words and masked windows of the items, ready to look up."""

    def __init__(self, ids: list[int], texts: list[str]):
        codes, words, self.offsets = text_words(pa.array(texts, pa.string()))
        self.ids, self.words = np.array(ids, np.int64), word_hashes(words)[codes]
        length = np.diff(self.offsets)
        # an item of fewer words than an overlap has is looked for as a whole
        self.masks = [*MASKS, *(mask for n in np.unique(length[(length > 0) & (length < LEAST_WORDS)]) for mask in short_masks(n))]
        found = []
        for k, mask in enumerate(self.masks):
            for i in np.flatnonzero(length >= LEAST_WORDS if k < len(MASKS) else length == len(mask)):
                h = _window_hashes(self.words[self.offsets[i] : self.offsets[i + 1]], mask, k)
                found.append(np.column_stack([h, np.full(len(h), i, np.uint64), np.arange(len(h), dtype=np.uint64)]))
        table = np.concatenate(found) if found else np.empty((0, 3), np.uint64)
        table = table[np.argsort(table[:, 0], kind="stable")]
        self.hash, self.item, self.at = table[:, 0].copy(), table[:, 1].astype(np.int64), table[:, 2].astype(np.int64)
        self.bits = 22
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def seeds(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of the hits near which enough words are equal, a diagonal being a text's place less an item's."""
        found = [np.empty((0, 3), np.int64)]
        row_end = np.repeat(offsets[1:], np.diff(offsets))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for k, mask in enumerate(self.masks):
            h = _window_hashes(words, mask, k)
            at = np.flatnonzero(self.filter[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            at = at[at + len(mask) <= row_end[at]]
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            ends = np.cumsum(hi - lo)
            for first in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                hit = np.arange(first, min(first + HITS, int(ends[-1])))
                one = np.searchsorted(ends, hit, "right")
                place, entry = at[one], hi[one] - (ends[one] - hit)
                text, item, of = row[place], self.item[entry], self.at[entry]
                near = self._near(words, place, offsets[text], offsets[text + 1], item, of, len(mask) if k >= len(MASKS) else 0)
                found.append(np.unique(np.column_stack([text, item, place - offsets[text] - of])[near], axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def _near(self, words: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray, of: np.ndarray, whole: int) -> np.ndarray:
        """Whether the hits (a place in words, of a text from start to end, and one in an item) may be in an overlap.

        That is, if a piece of 13 to 25 words around the hit, or with ``whole`` the whole of so many words, has enough equal ones.
        """
        step = np.arange(whole) if whole else np.arange(-2 * LEAST_WORDS, 2 * LEAST_WORDS)
        a, b = place[:, None] + step, (self.offsets[item] + of)[:, None] + step
        inside = (a >= start[:, None]) & (a < end[:, None]) & (b >= self.offsets[item][:, None]) & (b < self.offsets[item + 1][:, None])
        equal = inside & (words[np.where(inside, a, 0)] == self.words[np.where(inside, b, 0)])
        sums = np.pad(np.cumsum(equal, axis=1, dtype=np.int8), ((0, 0), (1, 0)))
        out = np.zeros(len(place), bool)
        for n in [whole] if whole else range(LEAST_WORDS, 2 * LEAST_WORDS):
            out |= (sums[:, n:] - sums[:, :-n]).max(axis=1) >= SIMILARITY * n - 1e-9
        return out

    def overlaps(self, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """text, item id, first word in the text, first word in the item, words and equal words of each text's best overlap with an item."""
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for text, item, diagonal in self.seeds(words, offsets):
            a, b = words[offsets[text] : offsets[text + 1]], self.words[self.offsets[item] : self.offsets[item + 1]]
            lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
            equal = a[lo + diagonal : hi + diagonal] == b[lo:hi]
            found = longest_overlap(equal)
            if found and found[1] - found[0] >= min(LEAST_WORDS, len(b)):
                start, end = found
                new = (int(equal[start:end].sum()), -(end - start), int(start + lo + diagonal), int(start + lo))
                if new > best.get((text, item), (0, 0, 0, 0)):
                    best[text, item] = new
        return [(text, int(self.ids[item]), at, of, -n, same) for (text, item), (same, n, at, of) in best.items()]


def longest_overlap(equal: np.ndarray) -> tuple[int, int] | None:
    """The longest stretch (start, end) that begins and ends with equal words and has SIMILARITY of them; None if none is equal."""
    hit = np.flatnonzero(equal)
    if not len(hit):
        return None
    # with s the sum of (equal - SIMILARITY), a stretch a..b is good if s[b+1] >= s[a]: the longest by a monotone sweep
    s = np.r_[0.0, np.cumsum(equal - SIMILARITY)]
    starts = hit[np.r_[True, s[hit][1:] < np.minimum.accumulate(s[hit])[:-1]]]
    ends = hit[::-1] + 1
    ends = ends[np.r_[True, s[ends][1:] > np.maximum.accumulate(s[ends])[:-1]]][::-1]
    best, k = (0, 0), 0
    for a in starts:
        k = max(k, int(np.searchsorted(ends, a, "right")))
        while k < len(ends) and s[ends[k]] >= s[a] - 1e-9:
            if ends[k] - a > best[1] - best[0]:
                best = (int(a), int(ends[k]))
            k += 1
        k = max(0, k - 1)
    return best if best[1] > best[0] else None


OVERLAP = "doc_id long, item_id long, doc_word int, item_word int, n_words int, n_equal int"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, item_id and the longest verified overlap of each row of docs with each benchmark item that it overlaps.

    Words are lower-cased runs of letters, marks and digits. The overlap is without gaps, has LEAST_WORDS words (or all of
    the item's, if it has fewer) and SIMILARITY of them are equal. Null or empty texts overlap nothing; repeated rows are
    each reported; repeated items are reported by item; items without an id are void. Every window of every text is looked up.

    The benchmark's hashes go to the tasks while it has at most ``part_words`` words; a larger one is dealt into parts by
    a hash of the item, and the texts are read once for each part, whose overlaps are written to the shared folder.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def part(given: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*given.value)
            for batch in slices(batches, "text", 8 << 20):
                codes, distinct, offsets = text_words(batch["text"])
                ids = batch["id"].to_pylist()
                rows = [(ids[t], *rest) for t, *rest in bench.overlaps(word_hashes(distinct)[codes], offsets)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.int32()) for k in range(6)], names=[c.split()[0] for c in OVERLAP.split(", ")])

        return chosen.mapInArrow(run, OVERLAP)

    first, *rest = _parts(benchmark, item_col, item_text_col, part_words)
    found = materialise(part(first()), "overlaps") if rest else part(first())
    for given in rest:
        found = found.unionByName(materialise(part(given()), "overlaps"))
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """The rows of docs that overlap no benchmark item (see find_overlaps), with the columns of docs. Each row is judged by its own text, whatever its id."""
    names, text = docs.columns, f"__c{docs.columns.index(text_col)}"
    inner = [f"__c{i}" for i in range(len(names))]
    kinds = ", ".join(f"{c} {docs.schema[name].dataType.simpleString()}" for c, name in zip(inner, names, strict=True))
    kept = docs.select(*[F.col(name).alias(c) for c, name in zip(inner, names, strict=True)])
    for i, given in enumerate(_parts(benchmark, item_col, item_text_col, part_words)):
        given = given()

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*given.value)
            for batch in slices(batches, text, 8 << 20):
                codes, distinct, offsets = text_words(batch[text].cast(pa.string()))
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, *_ in bench.overlaps(word_hashes(distinct)[codes], offsets)]] = False
                yield batch.filter(pa.array(keep))

        kept = (materialise(kept, "clean") if i else kept).mapInArrow(run, kinds)
    return kept.select(*[F.col(c).alias(name) for c, name in zip(inner, names, strict=True)])


def _parts(benchmark: DataFrame, item_col: str, text_col: str, part_words: int) -> list[Callable[[], Broadcast]]:
    """The items as ids and texts in parts of about so many words, each broadcast when it is called for; one part at least."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    words = items.agg(F.sum(F.size(F.split("text", NO_WORD)))).first()[0] or 0
    parts = max(1, -(-words // part_words))

    def part(i: int) -> Broadcast:
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).sort("id", "text").collect()
        return benchmark.sparkSession.sparkContext.broadcast(([r["id"] for r in own], [r["text"] for r in own]))

    return [partial(part, i) for i in range(parts)]
