"""Lookup by stored neighbourhoods against comparing every term with every form."""

import random

import pytest

from corpuslens.operators import lookup, search


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(word, rng, n):
    for _ in range(n):
        i = rng.randrange(len(word) + 1)
        word = rng.choice([word[:i] + rng.choice("abc") + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice("abc") + word[i + 1 :]])
    return word


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(1)
    forms = {"".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 31, 32, 33, 34, 40, 70]))) for _ in range(150)}
    alias = [(f, f"k{i % 90}") for i, f in enumerate(sorted(forms))] + [("é^ab", "mark"), ("", "none")]
    path = str(tmp_path_factory.mktemp("forms") / "index")
    lookup.write_forms(spark.createDataFrame(alias, "alias string, key string"), path)
    return alias, path, rng


def test_terms_equal_comparing_all_pairs(spark, stored):
    alias, path, rng = stored
    forms = [(f, k) for f, k in alias if f]
    df = {k: rng.randrange(1, 9) for _, k in forms if k != "k7"}
    texts = [changed(rng.choice(forms)[0], rng, rng.randrange(4)) for _ in range(150)]
    queries = [[t] for t in texts] + [[], ["a"], ["zzzzzz"], ["zz", "ab"], ["abcd", "abcd"], [""], ["ab"], ["^ab"]]
    asked = spark.createDataFrame(list(enumerate(queries)), "qid long, variants array<string>")
    got = {}
    for r in lookup.resolve_terms(spark, path, asked, spark.createDataFrame(list(df.items()), "key string, df long"), limit=None).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.key, r.tier, r.dist, r.df)
    for i, variants in enumerate(queries):
        terms = [v for v in variants if len(v) >= 2]
        best = {}
        for f, k in forms:
            tiers = [3 if f == v else 2 if f.startswith(v) else 1 if len(v) >= 3 and v in f else 0 for v in terms]
            if k in df and max(tiers, default=0):
                best[k] = min(best.get(k, (0, 0)), (-max(tiers), 0))
        if not best and terms:
            most = 1 if len(variants[0]) <= 4 else 2
            for f, k in forms:
                d = min(edits(f, v) for v in terms)
                if k in df and d <= most:
                    best[k] = min(best.get(k, (0, 9)), (0, d))
        want = [(k, -t, d, df[k]) for t, d, _, k in sorted((t, d, -df[k], k) for k, (t, d) in best.items())]
        assert [got.get(i, {}).get(n + 1) for n in range(len(want))] == want and len(got.get(i, {})) == len(want), variants


def test_names_equal_comparing_all_pairs(spark, stored):
    alias, path, rng = stored
    forms = [(f, k) for f, k in alias if f]
    names = [changed(rng.choice(forms)[0], rng, rng.randrange(4)) for _ in range(80)] + ["a", "ab", "cd", "abcdabcd", ""]
    got = {}
    for r in lookup.near_names(spark, path, spark.createDataFrame(list(enumerate(names)), "qid long, name string")).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.key, r.dist))
    for i, name in enumerate(names):
        best = {}
        for f, k in forms if len(name) >= 2 else []:
            d = 0 if name in f or name.startswith(f) else edits(f, name)
            if d <= 2:
                best[k] = min(best.get(k, 9), d)
        want = [(n + 1, k, d) for n, (d, k) in enumerate(sorted((d, k) for k, d in best.items())[:5])]
        assert sorted(got.get(i, [])) == want, name


def test_one_term_equals_search_over_all_aliases(spark, stored):
    alias, path, _ = stored
    df = spark.createDataFrame([(k, len(k)) for k in sorted({k for _, k in alias})], "key string, df int")
    for term in ("abc", "dcba", "zabz"):
        one = [tuple(r) for r in search.resolve(spark.createDataFrame([a for a in alias if a[0]], "alias string, key string"), term, df, stems=False).select("key", "tier", "dist", "df").collect()]
        many = lookup.resolve_terms(spark, path, spark.createDataFrame([(0, [term])], "qid int, variants array<string>"), df)
        assert [tuple(r) for r in many.orderBy("rank").select("key", "tier", "dist", "df").collect()] == one
