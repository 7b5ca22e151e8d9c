"""Alignment by batch against going through tokens one by one."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from test_operators import ODD, frame, words
from tokenizers import Tokenizer

from corpuslens.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def byte_of():
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    for b in range(256):
        if b not in own:
            out[chr(0x100 + len(out) - len(own))] = b
    return out


BYTE = byte_of()


def spans(text, libraries):
    """(id, begin, end) of each token of A and of B, or none."""
    a, b = libraries
    if not text:
        return [], []
    one = [(i, bytes(BYTE[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
    out = []
    for tokens in (one, two):
        if b"".join(x for _, x in tokens) != (" " + text).encode():
            return [], []
        at, row = 0, []
        for i, x in tokens:
            row.append((i, at, at + len(x)))
            at += len(x)
        out.append(row)
    return out


def plain(texts, libraries):
    docs, counts = [], Counter()
    for text in texts:
        one, two = spans(text, libraries)
        links, j = [], 0
        for i, lo, hi in one:
            while j and two[j - 1][2] > lo:
                j -= 1
            while j < len(two) and two[j][1] < hi:
                if two[j][2] > lo:
                    links.append((i, two[j][0]))
                j += 1
        cuts = sorted({e for _, _, e in one} & {e for _, _, e in two})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, x, y in side if lo <= x and y <= hi) for side in (one, two)))
            lo = hi
        counts.update(links)
        docs.append((len(one), len(two), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(a, b, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for a, b, g, ls, sha in docs]


def strings(n, seed):
    rng = random.Random(seed)
    spaces = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " ", " ", "　", "\r\n", "\x1c", "\x85", "   "]
    parts = ["don't", "we'LL", "naïve", "x1y2", "¿qué", "日本語", "…", "“so”", "é", "\U0001f600", "<|endoftext|>", "</s>", "<0x0A>", "'s", "--", "12345", "the", "of", "straße", "Ünï"]
    return ["".join(rng.choice(parts) + rng.choice(spaces) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_alignment_equals_plain_version(spark, libraries):
    texts = [*ODD, *strings(80, 1), "▁ has the mark", " lead", "trail ", "a  b", "\n", "same text", "same text", words(3000, 2)]
    got = alignment.align(frame(spark, texts), A, B)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == [(i, *row) for i, row in enumerate(plain(texts, libraries))]


def test_batches_of_any_size_give_the_same(spark, libraries, monkeypatch):
    import pyarrow as pa

    encoders = alignment.Encoders(A, B)
    texts = strings(40, 3)
    want = plain(texts, libraries)
    monkeypatch.setattr(alignment, "REMEMBERED", 60)
    for size in (1, 7, 40):
        rows = []
        for i in range(0, len(texts), size):
            found = alignment.encoded_batch(encoders, pa.array(texts[i : i + size]))
            text, ends = found.written()
            sha = [hashlib.sha256(text[lo : hi - 1]).hexdigest() for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
            rows += zip(found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), found.n_links.tolist(), sha, strict=True)
        assert rows == [(a, b, g, n, sha) for a, b, g, n, _, _, sha in want]


def test_empty_tables_null_and_repeated_ids(spark):
    assert alignment.align(frame(spark, []), A, B).collect() == []
    rows = alignment.align(frame(spark, [None, "", None], ids=[1, 1, None]), A, B).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(1, 0, 0, 0, 0, 0, 0, "")] * 2 + [(None, 0, 0, 0, 0, 0, 0, "")], key=repr)
    twice = alignment.align(frame(spark, ["one two", "one two"], ids=[3, 3]), A, B).collect()
    assert twice[0] == twice[1] and twice[0].count_sum == 2 * twice[0].n_links
