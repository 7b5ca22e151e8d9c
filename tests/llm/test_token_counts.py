"""The compiled tokenizer against the library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from test_operators import ODD, frame, words

from corpuslens.llm import token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def strings(n, seed, machine):
    rng, pieces = random.Random(seed), list(machine.score)
    kinds = [
        lambda k: "".join(rng.choice(pieces) for _ in range(k)).replace("▁", rng.choice([" ", ""])),
        lambda k: "".join(rng.choice("ab cde  \n▁\t") for _ in range(k * 3)),
        lambda k: "".join(rng.choice("aaaabn") for _ in range(k * 20)),
        lambda k: rng.choice("ae=-") * rng.randrange(1500),
        lambda k: "".join(chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(k)),
        lambda k: " " * rng.randrange(200) + "".join(rng.choice(machine.symbols[1:]) for _ in range(k)),
    ]
    return [rng.choice(kinds)(rng.randrange(1, 50)) for _ in range(n)]


def test_counts_equal_the_library(machine, library):
    texts = [*ODD, *strings(4000, 1, machine), "<s>a</s><unk><0x0A>", "\x00", " ", "  ", "a ", "x" * 70 + " " + "日" * 200]
    assert token_counts.text_counts(machine, pa.array(texts)).tolist() == [len(library.encode(t or "")) for t in texts]


def test_blocks_compose_and_states_are_forgotten(machine, library, monkeypatch):
    """Small blocks with few candidates, so that maps are composed, or walked where they lack a state."""
    texts = strings(600, 2, machine)
    want = [len(library.encode(t)) for t in texts]
    for block, candidates, warm in ((8, 4, 8), (5, 2, 1), (16, 1, 2)):
        monkeypatch.setattr(token_counts, "BLOCK", block)
        monkeypatch.setattr(token_counts, "CANDIDATES", candidates)
        monkeypatch.setattr(token_counts, "WARM", min(warm, block))
        assert token_counts.text_counts(machine, pa.array(texts)).tolist() == want
    monkeypatch.setattr(token_counts, "MOST_STATES", 500)
    monkeypatch.setattr(token_counts, "PORTION", 2000)
    assert token_counts.text_counts(machine, pa.array(texts)).tolist() == want


def test_neighbours_are_tried_as_merging_would(machine):
    rng, pieces = random.Random(3), list(machine.score)
    for _ in range(20_000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        if machine.merged(a) == [a]:
            assert machine.follows(a, b) == (machine.merged(a + b) == [a, b]), (a, b)


def test_maps_agree_with_walking(machine):
    """The map of a text, composed from its blocks, is that of going through it symbol by symbol."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdehnrst") for _ in range(rng.randrange(1, 400))) for _ in range(50)]
    symbols = machine.symbol_of[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
    offsets = np.cumsum([0, *map(len, texts)])
    assert machine.counts(symbols, offsets).tolist() == [machine.walk(symbols[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_rows_of_the_operator(spark, library):
    texts = [*ODD, words(5000, 3), "twice", "twice"]
    rows = token_counts.count_tokens(frame(spark, texts, ids=[*range(len(ODD)), None, 7, 7]), PIECES, limit=100).collect()
    want = [(len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for t in texts]
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(want)
    assert sorted((r.doc_id for r in rows), key=repr) == sorted([*range(len(ODD)), None, 7, 7], key=repr)
    assert token_counts.count_tokens(frame(spark, []), PIECES).collect() == []
    with pytest.raises(Exception):  # noqa: B017  another kind of file
        token_counts.Transducer(public_tokenizers.path("word_bpe_49k.json"))
