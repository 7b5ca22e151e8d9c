"""Token counts by a tokenizer that is compiled to a finite-state transducer.

A piece tokenizer merges, best score first, neighbouring symbols whose union is a piece. Whatever it makes of a text, two
neighbouring tokens are those it makes of their union alone, and a row of tokens of which every two neighbours are so is
what it makes of the text. So after each symbol every place may end at most one token of the text read so far, and a
state need only hold the places from which a piece may still grow, with the token that ends there and by how many tokens
the ways to them differ. What all ways have in common is the count that a transition emits. States are made when a text
first reaches them (as in a lazily built automaton) and forgotten together when there are many.

Texts are cut before each run of spaces, where no piece crosses, so that all states lead to one: such a chunk's map of
states is a constant and its count a number, which is found once for each distinct chunk of a slice and added up by a
prefix sum over the slice. Chunks of many symbols are cut into blocks; each block's map is found for the states that the
blocks before it may end in, and the maps are composed by a parallel prefix scan.

A null or empty text has no tokens; a null id is kept; repeated rows count each; an empty table gives no rows; texts and
words of any length are whole. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import record, slices

SPACE = "▁"
#: Symbols of a block, candidate states of its map, and symbols before it from which the first candidate is guessed.
BLOCK, CANDIDATES, WARM = 64, 4, 32
#: States after which all are forgotten, and symbols that are read between two looks at their number.
MOST_STATES, PORTION = 250_000, 1 << 19
#: Pieces that begin alike are looked at one by one while they are so few.
FEW = 30


class Transducer:
    """The compiled tokenizer: states are numbers, state 0 begins a text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain:
            raise ValueError(f"{path}: not a byte-pair model with byte fallback that leaves texts as they are")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if len(self.score) + sum(p.type in (2, 3, 6) for p in model.pieces) < len(model.pieces):
            raise ValueError(f"{path}: has pieces that users defined")
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or any(c not in self.score for p in self.score for c in p):
            raise ValueError(f"{path}: has pieces that cross words, or of other symbols")
        longer: dict[str, list[str]] = {}
        for p in self.score:
            for i in range(1, len(p)):
                longer.setdefault(p[:i], []).append(p)
        #: the pieces that begin so and are longer, or none where they are many
        self.longer = {begin: tuple(ps) if len(ps) <= FEW else None for begin, ps in longer.items()}
        self.sides = {p: self._sides(p) for p in self.score}
        self.symbols = ["", *sorted(p for p in self.score if len(p) == 1)]
        self.width = len(self.symbols) + 5
        # symbols that are no piece become their bytes: one class for each number of bytes
        self.symbol_of = np.repeat(np.arange(4, dtype=np.int32) + len(self.symbols), [0x80, 0x800 - 0x80, 0x10000 - 0x800, 0x110000 - 0x10000])
        self.symbol_of[[ord(c) for c in self.symbols[1:]]] = np.arange(1, len(self.symbols))
        self.forget()

    def forget(self) -> None:
        # a way to go on: the token that ends where it begins and what was read since, or, once these are few, the pieces it may become
        self.ways, self.way_number, self.way_steps, self.fits = [], {}, {}, {}
        begin = ((self._way(None, "", None), 0),)
        self.states, self.number = [begin], {begin: 0}
        self.owing = np.zeros(1 << 12, np.int32)
        self.filled, self._keys = 0, np.full(1 << 14, -1, np.int64)
        self._to, self._out = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _way(self, last: str | None, read: str, may: tuple | None) -> int:
        way = (None, read, may) if may else (last, read, None)
        if (number := self.way_number.get(way)) is None:
            number = self.way_number[way] = len(self.ways)
            self.ways.append(way)
        return number

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text, by merging."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.score[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.score]
            if not scored:
                break
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _sides(self, piece: str) -> tuple[list, list] | None:
        """What stands last, and what stands first, while a piece is merged: (part, score of the merge that takes it in) from its symbols on.

        None for a piece that merging doesn't make, or whose merges aren't made in order of score.
        """
        parts, last, first, score = list(piece), [], [], np.inf
        while len(parts) > 1:
            scored = [(-self.score[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.score]
            if not scored or -min(scored)[0] >= score:
                return None
            score, i = -min(scored)[0], min(scored)[1]
            if i == len(parts) - 2:
                last.append((parts[-1], score))
            if i == 0:
                first.append((parts[0], score))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [*last, (piece, -np.inf)], [*first, (piece, -np.inf)]

    def follows(self, last: str | None, token: str) -> bool:
        """Whether the token may stand after the last one, or begin a text: no merge across their border comes before those within."""
        one, two = self.sides[last] if last else ((), ()), self.sides[token]
        if not last and two:
            return True
        if one is None or two is None:
            if (known := self.fits.get((last, token))) is None:
                known = self.fits[last, token] = self.merged((last or "") + token) == ([last, token] if last else [token])
            return known
        lasts, firsts, i, j, score = one[0], two[1], 0, 0, self.score
        while True:
            (left, before), (right, after) = lasts[i], firsts[j]
            if (across := score.get(left + right)) is not None and across > before and across >= after:
                return False
            if before >= after:
                if before == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def _grow(self, way: int, symbol: int) -> tuple[int, int]:
        """What a way becomes with one more symbol: the way that begins behind it, if a token ends here, and the way that goes on, or -1."""
        last, read, may = self.ways[way]
        read += self.symbols[symbol]
        if may:
            fits, more = read in may, tuple(p for p in may if len(p) > len(read) and p.startswith(read))
        else:
            fits = read in self.score and self.follows(last, read)
            if more := self.longer.get(read, ()):
                more = tuple(p for p in more if self.follows(last, p))
        return self._way(read, "", None) if fits else -1, -1 if more == () else self._way(last, read, more)

    def made(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the tokens that are certain by then."""
        if symbol >= len(self.symbols):
            return 0, int(self.owing[state]) + symbol - len(self.symbols) + 1
        ended, live = None, []
        for way, n in self.states[state]:
            key = way * self.width + symbol
            if (to := self.way_steps.get(key)) is None:
                to = self.way_steps[key] = self._grow(way, symbol)
            if to[0] >= 0 and ended is None:
                ended = (to[0], n + 1)
            if to[1] >= 0:
                live.append((to[1], n))
        live.append(ended)
        sure = min(n for _, n in live)
        reached = tuple((way, n - sure) for way, n in live)
        if (number := self.number.get(reached)) is None:
            number = self.number[reached] = len(self.states)
            self.states.append(reached)
            if number >= len(self.owing):
                self.owing = np.r_[self.owing, np.zeros_like(self.owing)]
            self.owing[number] = ended[1] - sure  # what ends here is owed if the text does
        return number, sure

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place for it."""
        mask = len(self._keys) - 1
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask
        open_ = np.arange(len(keys))
        while len(open_):
            there = self._keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != -1)]
            slot[open_] = (slot[open_] + 1) & mask
        return slot

    def _add(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Stores transitions whose keys are new and differ."""
        while len(keys):
            slot = self._slots(keys)
            _, first = np.unique(slot, return_index=True)  # of keys that want one place, one gets it
            at = slot[first]
            self._keys[at], self._to[at], self._out[at] = keys[first], to[first], out[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, out = keys[rest], to[rest], out[rest]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state.astype(np.int64) * self.width + symbol
        slot = self._slots(keys)
        missing = np.unique(keys[self._keys[slot] == -1])
        if len(missing):
            new = np.array([self.made(*divmod(k, self.width)) for k in missing.tolist()], np.int32)
            self.filled += len(missing)
            old = (self._keys, self._to, self._out)
            if self.filled * 3 > len(self._keys):
                size = len(self._keys)
                while self.filled * 3 > size:
                    size *= 2
                self._keys, self._to, self._out = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
                used = old[0] >= 0
                self._add(old[0][used], old[1][used], old[2][used])
            self._add(missing, new[:, 0], new[:, 1])
            slot = self._slots(keys)
        return self._to[slot], self._out[slot]

    def run(self, symbols: np.ndarray, at: np.ndarray, n: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of n symbols leads from its state, and the tokens it emits; all runs take a step at once."""
        order = np.argsort(-n, kind="stable")
        at, n, state = at[order], n[order], state[order].astype(np.int32)
        out = np.zeros(len(n), np.int64)
        longest = int(n[0]) if len(n) else 0
        alive = len(n) - np.cumsum(np.bincount(n, minlength=longest + 1))
        for k in range(longest):
            m = alive[k]
            state[:m], emitted = self.step(state[:m], symbols[at[:m] + k])
            out[:m] += emitted
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], out[back]

    def walk(self, symbols: np.ndarray) -> int:
        """The tokens of one text, symbol by symbol."""
        state, n, known = 0, 0, {}
        for s in symbols.tolist():
            if (to := known.get((state, s))) is None:
                to = known[state, s] = self.made(state, s)
            state, n = to[0], n + to[1]
        return n + int(self.owing[state])

    def counts(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The tokens of each text of symbols."""
        length = np.diff(offsets)
        if not len(length) or length.max() <= BLOCK:
            end, out = self.run(symbols, offsets[:-1], length, np.zeros(len(length), np.int32))
            return out + self.owing[end]
        blocks = np.maximum(1, -(-length // BLOCK))
        last = np.cumsum(blocks) - 1
        text = np.repeat(np.arange(len(length)), blocks)
        nth = np.arange(len(text)) - (last - blocks + 1)[text]
        at = offsets[text] + nth * BLOCK
        n = np.minimum(BLOCK, offsets[text + 1] - at)
        maps = _Maps(self, symbols, at, n, nth)
        end, out, known = maps.composed(nth)
        result = out[last] + self.owing[np.maximum(end[last], 0)]
        for i in np.flatnonzero(~known[last]):  # blocks whose maps lack a state that is met: rare, as texts fall into step
            result[i] = self.walk(symbols[offsets[i] : offsets[i + 1]])
        return result


class _Maps:
    """The maps of blocks: up to CANDIDATES states in which a block may begin, with the states it then ends in and the tokens."""

    def __init__(self, machine: Transducer, symbols: np.ndarray, at: np.ndarray, n: np.ndarray, nth: np.ndarray):
        later = np.flatnonzero(nth > 0)
        shape = (len(at), CANDIDATES)
        self.begin, self.end, self.out = np.full(shape, -1, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, np.int64)
        self.begin[:, 0] = 0
        self.begin[later, 0] = machine.run(symbols, at[later] - WARM, np.full(len(later), WARM), np.zeros(len(later), np.int32))[0]
        todo, column = np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(todo):
            self.end[todo, column], self.out[todo, column] = machine.run(symbols, at[todo], n[todo], self.begin[todo, column])
            # each state a block ends in has to be a candidate of the next block
            met = self.end[later - 1]
            lacking = (met >= 0) & ~(met[:, :, None] == self.begin[later][:, None, :]).any(2)
            free = (self.begin[later] >= 0).sum(1)
            rows = np.flatnonzero(lacking.any(1) & (free < CANDIDATES))
            todo, column = later[rows], free[rows]
            self.begin[todo, column] = met[rows, lacking[rows].argmax(1)]
        # from a candidate of a block to the candidate of the next one
        self.link = np.full(shape, -1, np.int64)
        same = self.end[later - 1][:, :, None] == self.begin[later][:, None, :]
        self.link[later - 1] = np.where(same.any(2) & (self.end[later - 1] >= 0), same.argmax(2), -1)

    def composed(self, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each block, the state at its end, the tokens up to there, and whether both are known, from its text's begin on.

        A prefix scan in doubling steps: in each, the map over the last d blocks takes in the map over the d blocks before.
        """
        came, out = self.link.copy(), self.out.copy()  # over one block: the candidate of the next block, the tokens
        final = np.tile(np.arange(CANDIDATES), (len(nth), 1))  # the candidate of the last block itself
        d = 1
        while d <= (nth.max() if len(nth) else 0):
            rows = np.flatnonzero(nth >= d)
            way = came[rows - d]
            ok, safe = way >= 0, np.maximum(way, 0)
            new_came = np.where(ok, np.take_along_axis(came[rows], safe, 1), -1)
            new_out = out[rows - d] + np.take_along_axis(out[rows], safe, 1)
            new_final = np.where(ok, np.take_along_axis(final[rows], safe, 1), -1)
            came[rows], out[rows], final[rows] = new_came, new_out, new_final
            d *= 2
        known = final[:, 0] >= 0
        return self.end[np.arange(len(nth)), np.maximum(final[:, 0], 0)], out[:, 0], known


@lru_cache(1)
def _machine(path: str) -> Transducer:
    return Transducer(path)


def chunks(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code for each chunk, the distinct chunks, and the texts' offsets into the codes: a chunk is a run of spaces and what follows up to the next."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring(texts, SPACE)).as_py():  # counts as a space
        texts = pc.replace_substring(texts, SPACE, " ")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    space = np.frombuffer(whole or b"", np.uint8)[at[0] : at[-1]] == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[(at[:-1] - at[0])[np.diff(at) > 0]] = True
    starts = np.flatnonzero(begins) + at[0]
    coded = pc.dictionary_encode(pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, at[-1]].astype(np.int32)), whole or pa.py_buffer(b"")))
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(starts, at)


def text_counts(machine: Transducer, texts: pa.Array) -> np.ndarray:
    """The tokens of each text."""
    codes, distinct, offsets = chunks(texts)
    strings = distinct.to_pylist()
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    of = np.zeros(len(strings), np.int64)
    portion = np.cumsum(length) // PORTION
    cuts = np.flatnonzero(np.r_[True, portion[1:] != portion[:-1], True]) if len(strings) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if len(machine.states) + len(machine.ways) > MOST_STATES:
            machine.forget()
        points = np.frombuffer("".join(strings[lo:hi]).replace(" ", SPACE).encode("utf-32-le"), "<u4")
        of[lo:hi] = machine.counts(machine.symbol_of[points], np.r_[0, np.cumsum(length[lo:hi])])
    return np.diff(np.r_[0, np.cumsum(of[codes])][offsets])


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, as the model's own library counts the tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
        machine = _machine(model_path)
        for batch in slices(batches, "text", 16 << 20):
            n = text_counts(machine, batch["text"])
            size = pc.cast(pc.fill_null(pc.binary_length(batch["text"]), 0), pa.int64())
            yield record(schema, batch["id"], size, n, n > limit)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
