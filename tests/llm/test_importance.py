"""Sort-count importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from test_operators import ODD, frame, words

from corpuslens.llm import importance


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_buckets(text, most, buckets):
    ws = plain_words(text)
    return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(ws) - n + 1)]


def plain(rows, target, most, buckets, least, percent, seed):
    s, t = Counter(b for _, x in rows for b in plain_buckets(x, most, buckets)), Counter(b for x in target for b in plain_buckets(x, most, buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        own = plain_buckets(x, most, buckets)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x)) >= least])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0]))
    for j, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[4] = j + 1
    return sorted(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_draw_equals_plain_version(spark, most):
    texts = [*ODD, *(words(30 + i, i, 40) for i in range(60)), "same words " * 12, "same words " * 12, "Äà ß ÅB\x00cd\x7fe f g Ⅷ 日本 語" * 3]
    target = [words(50, 99, 40), None, "", "same WORDS"]
    got = importance.resample(frame(spark, texts), spark.createDataFrame([(x,) for x in target], "text string"), most_words=most, buckets=97, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(list(enumerate(texts)), target, most, 97, 20, 30, "2024")


def test_empty_tables_null_and_repeated_ids(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), none).count() == 0
    twice = importance.resample(frame(spark, [words(25, 1), words(25, 1), words(25, 2)], ids=[4, 4, None]), none, percent=100).collect()
    assert sorted(r["rank"] for r in twice) == [1, 2, 3] and {r.score for r in twice if r.doc_id == 4} == {next(r.score for r in twice if r.doc_id == 4)}
    with pytest.raises(ValueError):
        importance.bucket_streams(none, buckets=1 << 17)


def test_words_of_a_slice_of_an_array():
    texts = pa.array(["skipped", "A b-b", None, "", "1x", " é"]).slice(1)
    codes, distinct, offsets = importance.ascii_words(texts)
    assert [[distinct[c].decode() for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [["a", "b", "b"], [], [], ["1x"], ["é"]]
