"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word in a language is
the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities; a forward algorithm sums them,
and a forward-backward pass gives the expected piece counts that the probabilities are re-estimated from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered, held_out, materialise, mix64, rows_of, slices, text_words, total

START = "▁"
#: A longer run of letters is scored in blocks of this many characters, which no piece crosses.
LONGEST = 40
#: Per-character scale, so that products of many probabilities stay within a double's range.
SCALE = 24.0
_MANY = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary's pieces of letters, lower-cased, in a hash table that numpy can look up."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.pieces = sorted({p for p in found if all(c.isalpha() or c == START for c in p) and p.rfind(START) <= 0 and len(p) <= LONGEST})
        self.longest = max(map(len, self.pieces))
        #: Two more entries: a character that is no piece, and no piece at all.
        self.unknown, self.none = len(self.pieces), len(self.pieces) + 1
        self.bits = 20
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, self.none, np.int32)
        self.probes = 1
        hashes = np.zeros(len(self.pieces), np.uint64)
        for n in sorted(set(map(len, self.pieces))):
            at = [i for i, p in enumerate(self.pieces) if len(p) == n]
            h = np.zeros(len(at), np.uint64)
            for chars in np.frombuffer("".join(self.pieces[i] for i in at).encode("utf-32-le"), "<u4").reshape(-1, n).T.astype(np.uint64):
                h = mix64((h ^ chars) * _MANY)
            hashes[at] = h
        for i, (h, slot) in enumerate(zip(hashes, (hashes >> np.uint64(64 - self.bits)).tolist(), strict=True)):
            n = 1
            while self.at[slot] != self.none:
                slot, n = (slot + 1) % (1 << self.bits), n + 1
            self.keys[slot], self.at[slot], self.probes = h, i, max(self.probes, n)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.where(self.keys[slot] == h, self.at[slot], self.none)
        for n in range(1, self.probes):
            s = (slot + n) & ((1 << self.bits) - 1)
            found = np.where(self.keys[s] == h, self.at[s], found)
        return found

    def lattice(self, chars: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
        """Of words of one length (rows of code points): for each end, the starts and the piece from there, or none."""
        n = chars.shape[1]
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
        with np.errstate(over="ignore"):
            for start in range(n):
                h = np.zeros(len(chars), np.uint64)
                for end in range(start + 1, min(n, start + self.longest) + 1):
                    h = mix64((h ^ chars[:, end - 1]) * _MANY)
                    piece = self.find(h)
                    if end == start + 1:
                        piece = np.where(piece == self.none, self.unknown, piece)
                    out[end].append((start, piece))
        return out


@lru_cache(1)
def pieces(path: str) -> Pieces:
    with np.errstate(over="ignore"):
        return Pieces(path)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the words (each with START before it): the places and code points of those of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), 1 << 15):
            some = at[i : i + (1 << 15)]
            yield some, np.frombuffer("".join(START + words[k] for k in some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)


def _scaled(vocabulary: Pieces, probability: np.ndarray) -> np.ndarray:
    """Rows of pieces (with unknown and none), columns of languages, times SCALE for each character."""
    length = np.array([*map(len, vocabulary.pieces), 1])
    return np.r_[probability * (SCALE ** length)[:, None], np.zeros((1, probability.shape[1]))]


def word_scores(vocabulary: Pieces, probability: np.ndarray, words: list[str]) -> np.ndarray:
    """The log probability of each word in each language, summed over all segmentations."""
    p, out = _scaled(vocabulary, probability), np.zeros((len(words), probability.shape[1]))
    for at, chars in _by_length(words):
        n = chars.shape[1]
        alpha = np.zeros((n + 1, len(at), p.shape[1]))
        alpha[0] = 1
        for end, ways in enumerate(vocabulary.lattice(chars)):
            for start, piece in ways:
                some = np.flatnonzero(piece != vocabulary.none)
                if len(some):
                    alpha[end, some] += alpha[start, some] * p[piece[some]]
        out[at] = np.log(alpha[n]) - n * np.log(SCALE)
    return out


def expected_counts(vocabulary: Pieces, probability: np.ndarray, words: list[str], lang: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by each language over the words' segmentations (forward-backward)."""
    p, langs = _scaled(vocabulary, probability), probability.shape[1]
    out = np.zeros((len(p), langs))
    for at, chars in _by_length(words):
        n, own = chars.shape[1], lang[at]
        ways = vocabulary.lattice(chars)
        alpha, beta = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
        alpha[0] = beta[n] = 1
        for end in range(1, n + 1):
            for start, piece in ways[end]:
                alpha[end] += alpha[start] * p[piece, own]
        for end in range(n, 0, -1):
            for start, piece in ways[end]:
                beta[start] += beta[end] * p[piece, own]
        weight = times[at] / alpha[n]
        for end in range(1, n + 1):
            for start, piece in ways[end]:
                some = np.flatnonzero(piece != vocabulary.none)
                out += np.bincount(piece[some] * langs + own[some], weight[some] * alpha[start, some] * p[piece[some], own[some]] * beta[end, some], minlength=out.size).reshape(out.shape)
    return out[:-1]


def _blocks(words: list[str]) -> list[list[str]]:
    return [[w] if len(w) < LONGEST else [w[i : i + LONGEST - 1] for i in range(0, len(w), LONGEST - 1)] for w in words]


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word and how often it occurs (n) over all rows of docs; long runs of letters count by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            codes, words, offsets = text_words(batch["text"], digits=False)
            langs = batch["lang"].dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows_of(offsets)]
            pair, n = np.unique(of * max(1, len(words)) + codes, return_counts=True)
            blocks = _blocks(words.to_pylist())
            code = pair % max(1, len(words))
            many = np.fromiter((len(blocks[c]) for c in code), np.int64, len(code))
            yield pa.RecordBatch.from_arrays([
                pa.array(langs.dictionary.take(pa.array(np.repeat(pair // max(1, len(words)), many)))),
                pa.array([b for c in code for b in blocks[c]], pa.string()),
                pa.array(np.repeat(n, many)),
            ], names=["lang", "word", "n"])

    chosen = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, vocabulary_path: str, rounds: int = 3, smooth: float = 0.05) -> tuple[list[str], np.ndarray]:
    """The languages and the piece probabilities (pieces and the unknown character by languages) after rounds of re-estimation.

    Each round's expected counts are summed by piece and language; languages times pieces of them come to the driver.
    """
    spark = counts.sparkSession
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    size = pieces(vocabulary_path).unknown + 1
    probability = np.full((size, max(1, len(langs))), 1 / size)
    for _ in range(rounds if langs else 0):
        given = spark.sparkContext.broadcast(probability)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            vocabulary, sums = pieces(vocabulary_path), np.zeros((size, len(langs)))
            place = {x: i for i, x in enumerate(langs)}
            for batch in gathered(batches, 200_000):
                lang = np.fromiter((place[x] for x in batch["lang"].to_pylist()), np.int64, batch.num_rows)
                sums += expected_counts(vocabulary, given.value, batch["word"].to_pylist(), lang, batch["n"].to_numpy().astype(float))
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(sums[piece, lang])], names=["piece", "lang", "n"])

        found = counts.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros(probability.shape)
        sums[found["piece"], found["lang"]] = found["n"]
        probability = (sums + smooth) / (sums + smooth).sum(axis=0)
        # a character outside the vocabulary tells nothing about the language
        probability[-1] = probability[-1].min()
    return langs, probability


def identify(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score of each row of docs.

    Learns from text and language of the rows that have a language and aren't held out; the prediction sees the text
    alone. Languages are equally likely beforehand; score is the posterior of the best one, ties go to the first by code
    point. A null text or one without letters is ``und`` with score 0, as is every text if there is no language to learn.
    Repeated rows are each scored.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col))
    langs, probability = fit(materialise(word_counts(known, text_col, lang_col), "language-words"), vocabulary_path)
    model = spark.sparkContext.broadcast(probability)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(vocabulary_path)
        for batch in slices(batches, "text", 8 << 20):
            codes, words, offsets = text_words(batch["text"], digits=False)
            blocks = _blocks(words.to_pylist())
            score = word_scores(vocabulary, model.value, [b for x in blocks for b in x])
            by_word = np.column_stack([total(c, np.r_[0, np.cumsum([len(x) for x in blocks], dtype=np.int64)]) for c in score.T])
            sums = np.column_stack([total(c[codes], offsets) for c in by_word.T])
            best = sums.argmax(axis=1)
            posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            letters = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False).astype(np.int64)  # a run may be of marks only
            some = (total(letters[codes], offsets) > 0) & bool(langs)
            yield pa.RecordBatch.from_arrays([
                batch["id"],
                pa.array([langs[b] if s else "und" for b, s in zip(best, some, strict=True)], pa.string()),
                pa.array(np.where(some, np.clip(posterior, 0, 1), 0.0)),
            ], names=["id", "lang_pred", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
