"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import gc
import random
import re
import tracemalloc
import zlib
from collections import Counter
from datetime import date

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, langid, mixing, near_dup, pseudonyms, quality, shared, token_planes, top_k, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, __id int, v int, size int, key string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, texts, langs=None, sources=None, ids=None):
    """Documents with columns whose names might clash with those that operators use within."""
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), "x", 7, 8, 9, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(n, seed, vocabulary=500):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   ", "!!! ***", "one", "Ünï çödé — “quoted” don't  it's\ttabs\u00a0nbsp <|endoftext|> x", "a" * 3000, words(4000, 1)]


# --- shared --------------------------------------------------------------------------------------------------------------


def test_words_are_runs_of_letters_marks_and_digits():
    import regex

    texts = ["Hello, World’s “ÀB” 12a c", "", None, " x y ...", "a\nb\tc", "ǅ x_y z-1", "—"]
    for digits, pattern in ((True, r"[\p{L}\p{M}\p{N}]+"), (False, r"[\p{L}\p{M}]+")):
        codes, distinct, offsets = shared.text_words(pa.array(texts), digits)
        got = [[distinct[int(c)].as_py() for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [regex.findall(pattern, (t or "").lower()) for t in texts]


# --- 1 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    ids = np.random.default_rng(0).integers(0, 2**32, 1000, dtype=np.uint64).astype("<u4")
    sizes, parts = token_planes.pack(ids, planes)
    assert len(sizes) == (4 if planes == "byte" else 32)
    assert (token_planes.unpack(sizes, memoryview(b"".join(parts)), 1000, planes) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_ids_are_read_back(spark, tmp_path, monkeypatch, planes):
    from tokenizers import Tokenizer

    texts = ODD + ["same", "same", words(300, 2)]
    docs = frame(spark, texts, ids=[5, 3, 9, 1, 0, 2, 8, 7, 6, 6, 4])
    token_planes.write_ids(docs, str(tmp_path / "x"), TOKENIZER, planes=planes, shards=3)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_planes.digests(spark, str(tmp_path / "x")).orderBy("start").collect()]
    tokenizer, at, want = Tokenizer.from_file(TOKENIZER), 0, []
    for i, t in sorted(zip([5, 3, 9, 1, 0, 2, 8, 7, 6, 6, 4], texts, strict=True), key=lambda x: x[0]):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_documents_span_chunks():
    """A document over several chunk rows comes back whole."""
    old = token_planes.BLOCK, token_planes.BLOCKS
    token_planes.BLOCK, token_planes.BLOCKS = 4, 2
    try:
        chunks, rows = token_planes._Chunks("byte"), []
        chunks.shard = 0
        docs = [np.arange(n, dtype=np.uint32) + 100 * n for n in (3, 30, 5, 8, 1)]
        for i, d in enumerate(docs):
            rows += chunks.add(i, d)
        rows += [chunks.row(False)] if chunks.n else []
        schema = __import__("pyspark.sql.pandas.types", fromlist=["x"]).to_arrow_schema(token_planes.CHUNK)
        batch = pa.RecordBatch.from_pylist(rows, schema=schema)
        pieces = [p for split in (False, True) for b in token_planes._pieces(iter([batch]), split) for p in b.to_pylist()]
        for i, d in enumerate(docs):
            own = sorted((p for p in pieces if p["doc"] == i), key=lambda p: p["chunk"])
            assert b"".join(p["ids"] for p in own) == d.astype("<u4").tobytes() and {p["doc_id"] for p in own} == {i}
            assert own[0]["first_id"] == sum(map(len, docs[:i]))
    finally:
        token_planes.BLOCK, token_planes.BLOCKS = old


def test_words_are_encoded_as_the_tokenizer_does():
    """Each character of U+00C0 to U+024F, and some that change when composed or lower-cased, before marks and white space."""
    from tokenizers import Tokenizer

    rng, tokenizer, encode = random.Random(1), Tokenizer.from_file(TOKENIZER), token_planes.WordEncoder(TOKENIZER)
    texts = ["İ. x", "3 ×! x", "÷, y", "e\u0301. K! ʼn? ﬁ.", "a\u0338= b", "É!É ©. ª. º! ²?"]
    texts += [f"{chr(c)}{m} x{chr(c)}{m}\ty" for c in range(0xC0, 0x250) for m in (".", "!=")]
    texts += ["".join(rng.choices("aZ9éİ×÷ßŉǅ\u0301\u0307 .,!'\n\u00a0\u3000<|>", k=30)) for _ in range(3000)]
    ids, n = encode(pa.array(texts), 2)
    for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_empty_table_gives_empty_files(spark, tmp_path):
    token_planes.write_ids(frame(spark, []), str(tmp_path / "x"), TOKENIZER)
    assert token_planes.read_ids(spark, str(tmp_path / "x")).count() == 0


# --- 2 -------------------------------------------------------------------------------------------------------------------


def test_overlaps_with_substitutions(spark):
    item = [f"b{i}" for i in range(40)]
    changed = [w if i % 9 else f"other{i}" for i, w in enumerate(item)]
    texts = [words(50, 3), words(20, 4) + " " + " ".join(item).upper() + ". " + words(20, 5), words(300, 6) + " " + ", ".join(changed), " ".join(item[:11]), " ".join(item[5:25]), None, "", "tiny Item", "tiny other", " ".join(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Tiny item!"), (3, None), (4, ""), (5, " ".join(item))], "item_id long, text string")
    got = decontaminate.find_overlaps(frame(spark, texts), bench).collect()
    found = {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in got}
    assert found == {(d, i): v for d, v in ((1, (40, 40)), (2, (39, 35)), (4, (20, 20)), (9, (40, 40))) for i in (1, 5)} | {(7, 2): (2, 2)}
    parted = decontaminate.find_overlaps(frame(spark, texts), bench, part_words=30).collect()
    assert sorted(map(tuple, parted)) == sorted(map(tuple, got))


def test_longest_overlap_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(300):
        e = rng.random(rng.integers(1, 30)) < rng.choice([0.3, 0.7, 0.9])
        want = max((b - a for a in range(len(e)) for b in range(a + 1, len(e) + 1) if e[a] and e[b - 1] and e[a:b].sum() >= 0.8 * (b - a) - 1e-9), default=None)
        got = decontaminate.longest_overlap(e)
        assert (got[1] - got[0] if got else None) == want


def overlaps(items, texts):
    """What Benchmark finds for items and texts that are lists of numbers, by (text, item)."""
    bench = decontaminate.Benchmark(list(range(len(items))), [" ".join(f"w{x}" for x in item) for item in items])
    codes, distinct, offsets = shared.text_words(pa.array([" ".join(f"w{x}" for x in t) for t in texts], pa.string()))
    return bench, shared.word_hashes(distinct)[codes], offsets


@pytest.mark.parametrize("n", range(1, 26))
def test_every_placement_of_substitutions_has_a_hit(n):
    """Of an item of n words; a longer overlap has a piece of 13 to 25 words with as many equal. The ends of a whole short item are equal."""
    from itertools import combinations

    free = range(n) if n >= 13 else range(1, n - 1)
    texts = [[1000 + i if i in off else i for i in range(n)] for m in range(n // 5 + 1) for off in combinations(free, m)]
    bench, hashes, offsets = overlaps([range(n)], texts)
    assert set(bench.seeds(hashes, offsets)[:, 0]) == set(range(len(texts)))


def test_overlaps_by_brute_force():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 30, n).tolist() for n in (*range(1, 20), 30, 47, 80)]
    texts = [[], [1], rng.integers(0, 30, 200).tolist()]
    for item in items * 12:
        share, at = rng.choice([0.0, 0.1, 0.2, 0.3]), rng.integers(0, max(1, len(item) - 12))
        part = [int(rng.integers(0, 30)) if rng.random() < share else x for x in item[at:]]
        texts.append(rng.integers(0, 30, rng.integers(0, 20)).tolist() + part + rng.integers(0, 30, rng.integers(0, 20)).tolist())
    want = {}
    for t, a in enumerate(texts):
        for i, b in enumerate(items):
            for d in range(1 - len(b), len(a)):
                e = [a[k + d] == b[k] for k in range(max(0, -d), min(len(b), len(a) - d))]
                for x in np.flatnonzero(e):
                    for y in range(x + min(13, len(b)), len(e) + 1):
                        if e[y - 1] and 5 * sum(e[x:y]) >= 4 * (y - x):
                            want[t, i] = max(want.get((t, i), 0), y - x)
    bench, hashes, offsets = overlaps(items, texts)
    got = {(t, i): n for t, i, _, _, n, _ in bench.overlaps(hashes, offsets)}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in got) and len(want) > 150


def test_no_overlaps_with_an_empty_table(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlaps(frame(spark, ["a b c"]), bench).count() == 0
    assert decontaminate.find_overlaps(frame(spark, []), bench).count() == 0


# --- 3 -------------------------------------------------------------------------------------------------------------------


def labelled(n=300):
    texts, toxic, good = [], [], []
    for i in range(n):
        t = words(60, i, 80)
        toxic.append(int(i % 5 == 0))
        good.append(int(i % 10 != 0))
        texts.append(t + (" nasty vile " if toxic[-1] else "") + (" $$ junk" if not good[-1] else ""))
    return texts, toxic, good


def test_chain_finds_toxic_documents(spark):
    texts, toxic, good = labelled()
    held = list(range(200, 300))
    labels = spark.createDataFrame([(i, good[i], toxic[i]) for i in range(200)] + [(0, good[0], toxic[0]), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, texts + ODD + [texts[0]]), toxicity.categories(labels)).collect()}
    assert len(got) == 300 + len(ODD) + 1
    assert all(got[i].toxic == bool(toxic[i]) for i in held)
    assert all(0 <= p <= 1 for r in got.values() for p in (r.p_toxic, r.p_toxic_prose, r.p_toxic_junk))
    assert np.mean([got[i].p_toxic_junk > got[i].p_toxic_prose for i in held if toxic[i] and not good[i]]) > 0.9


def test_chain_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(frame(spark, ["a", None]), toxicity.categories(labels)).collect()
    assert [(r.toxic, r.p_toxic < 1e-9) for r in got] == [(False, True)] * 2
    assert toxicity.score_toxicity(frame(spark, []), toxicity.categories(labels)).count() == 0


# --- 4 -------------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    v = langid.pieces(PIECES)
    rng = np.random.default_rng(0)
    p = rng.random((v.unknown + 1, 2)) * 1e-3
    index = {x: i for i, x in enumerate(v.pieces)}

    def brute(s, k):
        if not s:
            return 1.0
        return sum((p[index[s[:n]], k] if s[:n] in index else p[v.unknown, k] if n == 1 else 0.0) * brute(s[n:], k) for n in range(1, len(s) + 1))

    for w in ("the", "läng", "世界x", "information"):
        got = langid.word_scores(v, p, [w])[0]
        assert np.allclose(np.exp(got), [brute("▁" + w, k) for k in range(2)])
    # each segmentation of a word uses all its characters once
    n = langid.expected_counts(v, p, ["information", "the"], np.array([0, 1]), np.array([2.0, 1.0]))
    lengths = np.array([*map(len, v.pieces), 1])
    assert np.allclose(lengths @ n, [2 * 12, 4])


def test_languages_are_told_apart(spark):
    base = {"en": "the house and the garden were with them under this weather", "fr": "la maison avec les jardins était pour nous sous le temps", "de": "das haus und der garten waren mit ihnen unter diesem wetter"}
    rng, texts, langs = random.Random(1), [], []
    for i in range(200):
        lang = list(base)[i % 3]
        texts.append(" ".join(rng.choices(base[lang].split(), k=12)))
        langs.append(lang if i % 7 else None)
    docs = frame(spark, texts + ODD + ["123 456 !"], langs + ["en"] * len(ODD) + [None])
    got = {r.doc_id: r for r in langid.identify(docs, PIECES).collect()}
    assert len(got) == 200 + len(ODD) + 1
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(200))
    assert all(got[i].lang_pred == list(base)[i % 3] for i in held)
    assert [got[i].lang_pred for i in (200, 201, 202, 203, 208)] == ["und"] * 5 and got[200].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_marks_alone_have_no_language(spark):
    docs = frame(spark, ["the house", "das haus", "\u2764\ufe0f 123", "\u0301", "\u0301 the"], ["en", "de", None, None, None], ids=[1, 2, 4, 6, 7])
    assert [r.lang_pred == "und" for r in langid.identify(docs, PIECES).orderBy("doc_id").collect()] == [False, False, True, True, False]


def test_no_language_to_learn(spark):
    assert [r.lang_pred for r in langid.identify(frame(spark, ["abc"], [None]), PIECES).collect()] == ["und"]
    assert langid.identify(frame(spark, []), PIECES).count() == 0


# --- 5 -------------------------------------------------------------------------------------------------------------------


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 300) == [50, 100, 150]
    assert mixing.targets([10, 1000, 500], [3, 1, 1], 1510) == [30, 740, 740]
    assert mixing.targets([], [], 0) == []
    assert sum(mixing.targets([1, 2, 3, 1000], [3, 3, 3, 1], 1006)) == pytest.approx(1006)


def test_tree_keeps_quotas_and_permutations_are_permutations():
    quota = np.array([1000, 0, 37, 5])
    split = mixing.split_quotas(quota, 7, 3)
    assert (split.sum(axis=0) == quota).all() and (split >= 0).all() and np.ptp(split.sum(axis=1)) <= 7
    for n in (1, 2, 3, 17, 1000):
        x = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(x) == list(range(n))


def test_mix_meets_its_targets(spark):
    texts = [words(n, n) for n in range(1, 120)] + [None, "", words(30, 5), words(30, 5)]
    sources = ["a" if i % 2 else "b" if i % 3 else None for i in range(121)] + ["a", "a"]
    docs = frame(spark, texts, sources=sources, ids=[*range(121), 200, 200])
    rows = mixing.plan_mix(docs, shards=5).collect()
    again = mixing.plan_mix(docs.repartition(7, "text"), shards=5).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in rows) == sorted((r.doc_id, r.size, r.taken) for r in again)
    size, taken, target = Counter(), Counter(), {}
    of = dict(zip([*range(121), 200, 200], sources, strict=True))
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken == sum(s["n_words"] for s in r.segments)
        assert all(0 <= s["first_word"] and s["first_word"] + s["n_words"] <= r.size and 0 <= s.shard < 5 for s in r.segments)
        size[of[r.doc_id]] += r.size
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [1, 2, 3], sum(size.values()))
    assert [target[s] for s in order] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) < 4 * max(1, size[s] // mixing.FEWEST) for s in size)


def test_the_tree_decides_what_the_shards_draw(spark, monkeypatch):
    docs = frame(spark, [words(n, n) for n in range(200, 260)] + [words(30_000, 1)], sources=["a", "b", None] * 20 + ["b"])
    drawn = lambda **o: {(r.doc_id, s.first_word, s["pass"]): (s.shard, s.n_words) for r in mixing.plan_mix(docs, **o).collect() for s in r.segments}
    few, many = drawn(shards=3), drawn(shards=16)
    assert few.keys() == many.keys() and few != many  # the quotas are exact, their shares are the tree's
    split, quota = mixing.split_quotas, {}

    def halved(q, shards, seed):
        monkeypatch.setattr(mixing, "split_quotas", split)
        return quota.setdefault("cut", split(q, shards, seed) // 2)

    monkeypatch.setattr(mixing, "split_quotas", halved)
    half = drawn(shards=16)
    assert half.keys() < many.keys()
    blocks = Counter(s for s, _ in half.values())
    assert all(blocks[s] >= quota["cut"][s].sum() for s in range(16))  # a block may lie in several documents
    monkeypatch.setattr(mixing, "split_quotas", lambda q, shards, seed: np.zeros((shards, len(q)), np.int64))
    assert drawn(shards=16) == {}


def test_mixed_documents_are_the_plan_s_words(spark):
    docs = frame(spark, [words(n, n) for n in range(50, 90)] + [None, ""], sources=["a", "b"] * 21)
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in plan.items() if v}
    assert mixing.plan_mix(frame(spark, [])).count() == 0


def test_written_mix_has_disjoint_blocks_in_shuffled_order(spark, tmp_path):
    docs = frame(spark, [words(n, n) for n in range(50, 90)], sources=["a", "b"] * 20)
    mixing.write_mix(docs, str(tmp_path / "m"), shards=3)
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in mixing.plan_mix(docs, shards=3).collect())
    assert {r.shard for r in rows} <= {0, 1, 2}


# --- 6 -------------------------------------------------------------------------------------------------------------------


def judge(url, rules):
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_urls_are_judged_as_by_comparing_all_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/e", "allow"), ("net", "/e", "block"), ("org", "", "block")]
    urls = [None, "", "no scheme", "http://", "http://COM", "http://com/", "HTTP://Www.Example.COM/en/x?y#z", "http://example.com/en/", "http://aexample.com/en/", "http://a.b.example.com/en/1", "x://y.net/es/1", "x://y.net/eqq", "x://y.net/", "http://É.org", "http://u@h.com:80/en/", "a\n://b.com/\nq", "http://x.org?q://b.com/", "http://y.net/es/1", "http://y.net/es/1"]
    pages = spark.createDataFrame([(i, u, "h", "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, n int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
    rng = random.Random(2)
    host, path = lambda: ".".join(rng.choices("ab", k=rng.randrange(1, 5))), lambda: "".join(rng.choices("/ab", k=rng.randrange(0, 7)))
    many = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)]
    urls2 = [f"x://{host()}/{path()}" for _ in range(400)] + ["x://a.b/" + "a/" * 3000]
    pages2 = spark.createDataFrame(list(enumerate(urls2)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages2, spark.createDataFrame(many, "host string, path string, verdict string")).collect()}
    assert got == {i: judge(u, many) for i, u in enumerate(urls2)}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


# --- 7 -------------------------------------------------------------------------------------------------------------------


def test_signatures_estimate_weighted_jaccard():
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join(w if (i + k) % 60 else f"x{k}" for i, w in enumerate(base)) for k in range(40)]
    elements, counts, offsets, _ = near_dup._sets(pa.array(texts))
    sig = near_dup.signatures(elements, counts, offsets)
    sets = [(elements[a:b], counts[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    true = np.array([near_dup.similarity(sets[0], s) for s in sets[1:]])
    assert abs((sig[1:] == sig[0]).mean() - true.mean()) < 0.03


def brute_classes(texts):
    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            whole = sum(sets[i].values()) + sum(sets[j].values()) - both
            if whole and both / whole >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_classes_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    texts = list(ODD)
    for g in range(12):
        base = words(120, 100 + g, 5000).split()
        texts += [" ".join(base), " ".join(base).upper() + "!"]
        for _ in range(6):
            w = list(base)
            for i in rng.sample(range(120), rng.choice([1, 1, 2, 6])):
                w[i] = f"new{rng.random()}"
            texts.append(" ".join(w))
    chain = words(200, 999, 5000).split()
    for k in range(8):  # each is near the next only
        texts.append(" ".join(chain[4 * k : 4 * k + 100]))
    texts += ["a b", "A, b", "one", "x " * 400, "x " * 420]
    got = [r.class_id for r in near_dup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == brute_classes(texts)


def test_a_group_of_copies_and_one_around_a_base(spark):
    base = words(120, 7, 5000).split()
    rng = random.Random(1)
    near = []
    for k in range(60):  # near the base, less so each other
        w = list(base)
        for i in rng.sample(range(120), 2):
            w[i] = f"y{k}x{i}"
        near.append(" ".join(w))
    texts = near + [" ".join(base)] + [words(80, 8)] * 100
    got = near_dup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert {r.class_id for r in got[:61]} == {0} and {r.class_id for r in got[61:]} == {61}
    assert {r.copy_of for r in got[61:]} == {61}


def changed(text, places, mark):
    """The text's words with some replaced: each, 5 words from others and the ends, takes five shingles away."""
    return " ".join(f"{mark}x{i}" if i in places else w for i, w in enumerate(text.split()))


def test_a_text_near_one_member_of_a_large_class(spark):
    """Each of the last texts reaches the threshold with one variant only (0.815), which its large buckets hold among all the others."""
    base = " ".join(f"b{i}" for i in range(200))
    rng = random.Random(3)
    spots = range(5, 195, 6)
    drawn = [rng.sample(spots, 7) for _ in range(400)]
    variants = [changed(base, p[:3], f"v{k}") for k, p in enumerate(drawn)]
    late = [changed(variants[k], drawn[k][3:], f"w{k}") for k in range(40)]
    got = near_dup.near_duplicates(frame(spark, [base, *variants, *late])).collect()
    assert len(got) == 441 and {r.class_id for r in got} == {0}


def test_tiles_meet_all_pairs(spark, monkeypatch):
    """Of buckets that are dealt into many parts."""
    monkeypatch.setattr(near_dup, "TILE", 3)
    texts = [changed(" ".join(f"b{i}" for i in range(100)), random.Random(k).sample(range(5, 95, 6), k % 4), f"v{k}") for k in range(40)]
    got = [r.class_id for r in near_dup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == brute_classes(texts)


@pytest.mark.parametrize("seed", [11, 21, 32])
def test_a_link_that_is_the_best_of_neither_text(spark, seed):
    """The first two texts are linked (0.814), but the signatures of both agree more with the third (0.796), which isn't linked."""
    base, spots = " ".join(f"s{seed}b{i}" for i in range(444)), list(range(5, 435, 6))
    texts = [changed(base, [*spots[a:b], spots[20]], mark) for a, b, mark in ((0, 4, "a"), (4, 8, "b"), (8, 13, "c"))]
    elements, counts, offsets, _ = near_dup._sets(pa.array(texts))
    sig = near_dup.signatures(elements, counts, offsets)
    assert (sig[0] == sig[1]).mean() < min((sig[i] == sig[2]).mean() for i in (0, 1))
    got = near_dup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.class_id for r in got] == brute_classes(texts) == [0, 0, 2]


def test_duplicates_of_odd_tables(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    got = near_dup.near_duplicates(frame(spark, ["a b c d e f", None, "", "!!", "a b c d e f"], ids=[3, 1, 2, 5, 3])).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (2, 2), (3, 3), (3, 3), (5, 5)]


def test_connected_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 3)], "u long, v long")
    assert {r.v: r.c for r in near_dup.connected(edges).collect()} == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


# --- 8 -------------------------------------------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0


def test_pseudonyms_keep_format_and_link_equal_values(spark):
    texts = ["card 4111 1111 1111 1111, again 4111111111111111.", "4111111111111111 4012888888881881", "bad 4111111111111112 and 1234", "on 2024-02-29 and 2023-02-29, 29/02/2024", "ip 8.196.197.208 not 8.196.197.300.", "+1 (743) 555-3824 or +1 (743) 555-3824", "ssn 123-45-6789 not 000-12-3456", "mail Ann.b@mail.example.com!", None, "", "1850-01-01 9999-12-31 0001-01-01"]
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(frame(spark, texts), "k").collect()}
    a = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[0].text)
    assert len(a) == 2 and a[0].replace(" ", "") == a[1] != "4111111111111111" and luhn(a[1])
    b = re.findall(r"\d{16}", got[1].text)
    assert b[0] == a[1] and luhn(b[1]) and got[1].n_found == 2
    assert got[2].text == texts[2] and got[2].n_found == 0 and got[2].found == []
    days = re.match(r"on (\S+) and 2023-02-29, (\S+)$", got[3].text)
    assert date.fromisoformat(days[1]).strftime("%d/%m/%Y") == days[2] and days[1] != "2024-02-29" and 1900 <= int(days[1][:4]) < 2100
    assert re.match(r"ip (\d+\.){3}\d+ not 8.196.197.300\.$", got[4].text) and "208 not" not in got[4].text
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[5].text)
    assert len(phones) == 2 and len(set(phones)) == 1 and phones[0] != "+1 (743) 555-3824"
    assert re.match(r"ssn \d{3}-\d{2}-\d{4} not 000-12-3456$", got[6].text) and "123-45-6789" not in got[6].text
    assert got[7].text.endswith("@mail.example.com!") and "Ann.b" not in got[7].text
    assert got[8].text is None and got[8].n_found == 0 and got[9].text == ""
    assert len(re.findall(r"\d{4}-\d{2}-\d{2}", got[10].text)) == 3 and not re.search("1850-01-01|9999-12-31|0001-01-01", got[10].text)
    other = {r.doc_id: r.text for r in pseudonyms.pseudonymise(frame(spark, texts), "other").collect()}
    assert other[0] != got[0].text
    assert pseudonyms.pseudonymise(frame(spark, []), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    x = spark.range(600).select("id", pseudonyms.permute(F.col("id"), F.lit(20).cast("long"), F.lit(30).cast("long"), "k", F.lit("t")).alias("y"))
    assert sorted(r.y for r in x.collect()) == list(range(600))
    d = spark.range(1000).select(pseudonyms.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("y"))
    assert sorted(r.y for r in d.collect()) == [f"{i:03d}" for i in range(1000)]


# --- 9 -------------------------------------------------------------------------------------------------------------------


def test_quality_is_learnt(spark):
    texts = [words(60, i) if i % 3 else "BUY!! NOW!! " * 30 + str(i) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(0, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(frame(spark, texts + ODD), labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and all(got[i].predicted == int(i % 3 > 0) for i in held)
    assert len(got) == 300 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score_quality(frame(spark, ["a", None]), none).collect()] == [0.5, 0.5]
    assert quality.score_quality(frame(spark, []), none).count() == 0


def test_isotonic_calibration_rises():
    rng = np.random.default_rng(0)
    at, n = np.arange(50) / 50, np.full(50, 20.0)
    knots, values = quality.isotonic(at, n, rng.binomial(20, at).astype(float))
    assert (np.diff(values) >= -1e-12).all() and (np.diff(knots) > 0).all()


# --- 10 ------------------------------------------------------------------------------------------------------------------


def brute_top(texts, ids, queries, k):
    tf = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    df = Counter(w for c in tf for w in c)
    n, size = len(texts), [sum(c.values()) for c in tf]
    mean, out = max(1, sum(size) / max(1, n)), {}
    for q, terms in queries.items():
        scores = []
        for i, c in enumerate(tf):
            s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w in terms if w in c)
            if ids[i] != q and s > 0:
                scores.append((-round(s, 6), ids[i]))
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("block", [3, 100])
def test_top_k_is_exact(spark, block):
    texts = [words(random.Random(i).randrange(1, 80), i, 120) for i in range(150)] + [None, "", "!!", words(40, 3, 120), words(40, 3, 120), "w1 w2 unseen", words(3000, 9, 150)]
    docs = frame(spark, texts).repartition(4)
    asked = docs.where("doc_id % 20 = 0 or doc_id = 155")
    got = {}
    for r in top_k.top_k(docs, asked, k=5, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    queries = {i: set(re.findall(r"[^\W_]+", (texts[i] or "").lower())) for i in range(len(texts)) if i % 20 == 0 or i == 155}
    assert got == {q: d for q, d in brute_top(texts, range(len(texts)), queries, 5).items() if d}


def test_top_k_of_empty_tables(spark):
    assert top_k.top_k(frame(spark, []), frame(spark, [])).count() == 0
    assert top_k.top_k(frame(spark, ["a"]), frame(spark, [])).count() == 0
    assert top_k.top_k(frame(spark, []), frame(spark, ["a"])).count() == 0


@pytest.mark.parametrize("few", [0, 1e9])
def test_top_k_adds_what_many_queries_found_at_once(monkeypatch, few):
    """Shards searched one after the other, whether or not postings of dropped blocks are passed over; more copies than are added at once."""
    monkeypatch.setattr(top_k, "FEW", few)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, rng.integers(1, 60)), 3000)) for _ in range(900)] + ["copy of w1 w77"] * 1500
    shards, asked = [(0, 500), (500, 501), (501, 2400)], [*range(0, 2400, 20)]
    sets = [set(t.split()) for t in texts]
    names = sorted(set().union(*sets))
    number = dict(zip(names, top_k.word_hashes(pa.array(names)), strict=True))
    queries = top_k.Queries(np.array(asked), [np.array(sorted(number[w] for w in sets[q]), np.uint64) for q in asked])
    count = Counter(number[w] for s in sets for w in s)
    df = np.array([count[h] for h in queries.vocabulary])
    idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
    lengths = np.array([len(t.split()) for t in texts])
    best, calls, add = top_k.Best(len(asked), 5, np.zeros(len(asked))), [], top_k.Best.add
    monkeypatch.setattr(top_k.Best, "add", lambda *a: (calls.append(1), add(*a))[1])
    for lo, hi in shards:
        row = top_k.shard_of(np.arange(lo, hi), pa.array(texts[lo:hi]))
        top_k.Shard(dict(zip([c.split()[0] for c in top_k.SHARD.split(", ")], row, strict=True)), queries, idf, lengths.mean()).search(queries, best)
    assert len(calls) < len(asked)
    weight = dict(zip(queries.vocabulary.tolist(), idf, strict=True))
    tfs = [Counter(t.split()) for t in texts]
    for at, q in enumerate(queries.ids):
        norm = top_k.K1 * (1 - top_k.B + top_k.B * lengths / lengths.mean())
        scores = [(-round(sum(weight[int(number[w])] * tfs[d][w] * (top_k.K1 + 1) / (tfs[d][w] + norm[d]) for w in sets[q] & sets[d]), 6), d) for d in range(len(texts)) if d != q]
        want = sorted(s for s in scores if s[0] < 0)[:5]
        some = best.score[at] >= 0
        assert best.doc[at][some].tolist() == [d for _, d in want]
        assert best.score[at][some] == pytest.approx([-s for s, _ in want], abs=2e-6)


class Batches:
    """Stands for a table in mapInArrow; gives what the function makes of the batches."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter(self.batches)))


def traced(run):
    """What run gives, and the bytes that it held at once."""
    gc.collect()
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_index_and_shards_hold_few_bytes():
    """A task makes postings of a part of its texts at a time, and a shard keeps counts in a byte or two, not scores of each document and list."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.2, 400), 20_000)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["id", "text"])
    rows, most = traced(lambda: top_k.build_index(Batches(batch)))
    size = sum(map(len, texts))
    assert sum(r.num_rows for r in rows) == 1
    assert most < 5 * size
    row = rows[0].to_pylist()[0]
    assert sum(len(x) for x in row.values() if isinstance(x, bytes)) < 0.5 * size
    hashes = [np.unique(top_k.word_hashes(pa.array(sorted(set(t.split()))))) for t in texts[::20]]
    queries = top_k.Queries(np.arange(0, 3000, 20), hashes)
    _, most = traced(lambda: top_k.Shard(row, queries, np.ones(len(queries.vocabulary)), 400.0))
    assert most < 4 * size


@pytest.mark.parametrize("limits", [{"SHARD_DOCS": 90, "PART_DOCS": 40}, {"SHARD_BYTES": 9000}, {"PART_DOCS": 7, "PART_BYTES": 500}, {"CELLS": 2000}, {"CELLS": 0, "SHARD_DOCS": 1, "PART_DOCS": 1}])
def test_top_k_is_exact_whatever_a_shard_holds(monkeypatch, limits):
    """Shards of few documents, made of small parts, with no more rows in the matrix than it has room for."""
    for name, most in limits.items():
        monkeypatch.setattr(top_k, name, most)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.4, rng.integers(1, 70)), 900)) for _ in range(400)] + ["w1 w2 w3"] * 60 + ["", "!!", "w1 " * 300 + "w9"]
    columns = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(texts[a:b])], names=["id", "text"])
    rows = [x for r in top_k.build_index(Batches(columns(0, 150), columns(150, len(texts)))) for x in r.to_pylist()]
    assert sum(r["n"] for r in rows) == len(texts)
    assert max(r["n"] for r in rows) <= top_k.SHARD_DOCS
    asked = {q: set(texts[q].replace("!", "").split()) for q in range(0, len(texts), 20)}
    queries = top_k.Queries(np.array(list(asked)), [np.unique(top_k.word_hashes(pa.array(sorted(t), pa.string()))) for t in asked.values()])
    names = sorted(set().union(*asked.values()))
    count = Counter(w for t in texts for w in set(t.split()))
    df = np.array([count[w] for _, w in sorted(zip(top_k.word_hashes(pa.array(names)).tolist(), names, strict=True))])
    idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
    best = top_k.Best(len(asked), 5, np.zeros(len(asked)))
    for row in rows:
        top_k.Shard(row, queries, idf, sum(r["words"] for r in rows) / len(texts)).search(queries, best)
    want = brute_top(texts, range(len(texts)), asked, 5)
    assert {int(q): best.doc[at][best.score[at] >= 0].tolist() for at, q in enumerate(queries.ids)} == {q: want[q] for q in asked}


def test_bytes_at_once_holds_meanwhile(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    docs = frame(spark, ["x" * 10_000] * 500).select("text").coalesce(1)
    sizes = lambda: [r.n for r in docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()]
    with pytest.raises(KeyError), shared.bytes_at_once(spark, 1 << 18):
        assert max(sizes()) < 1 << 19
        raise KeyError
    assert spark.conf.get(key, None) == old


def test_order_of_likeness_takes_as_many_terms_as_there_is_room_for(monkeypatch):
    monkeypatch.setattr(top_k, "CELLS", 1 << 18)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 500)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], names=["id", "text"])
    _, most = traced(lambda: top_k.build_index(Batches(batch)))
    assert most < 8 * sum(map(len, texts))


def test_queries_pass_few_shards_in_groups(spark, monkeypatch):
    """A wave of one shard was one task, whatever the number of queries."""
    rng = np.random.default_rng(5)
    docs = frame(spark, [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) % 300) for _ in range(160)])
    asked = docs.where("doc_id % 4 = 0")
    whole = top_k.top_k(docs, asked, k=5).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(top_k, "GROUP", 8)
    groups, kind = [], type(docs)
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (groups.append(self.select("grp").distinct().count()) if "grp" in self.columns else None, own(self, *a, **b))[1])
    assert top_k.top_k(docs, asked, k=5).orderBy("query_id", "rank").collect() == whole and len(whole) == 200
    assert max(groups) > 1


def test_block_products_have_only_rows_that_both_sides_have(monkeypatch):
    """Blocks of two languages: a block's product took the rows of both."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'ab'[i // 256]}{int(x)}" for x in rng.integers(0, 40, 60)) for i in range(512)]
    row = top_k.shard_of(np.arange(512), pa.array(texts))
    names = [f"{c}{i}" for c in "ab" for i in range(40)]
    queries = top_k.Queries(np.arange(512, 516), [np.sort(top_k.word_hashes(pa.array(names)))] * 4)
    shard = top_k.Shard(dict(zip([c.split()[0] for c in top_k.SHARD.split(", ")], row, strict=True)), queries, np.ones(len(queries.vocabulary)), 60.0)
    taken = []

    class Quick(np.ndarray):
        def __matmul__(self, other):
            return np.asarray(self) @ np.asarray(other)

        def __rmatmul__(self, other):
            taken.append(self.shape[0] if self.ndim == 2 else self.shape[1])
            return np.asarray(other) @ np.asarray(self)

    shard.quick = shard.quick.view(Quick)
    best = top_k.Best(4, 5, np.zeros(4))
    shard.search(queries, best)
    assert len(shard.row_most) == 80 and taken and max(taken) == 40
