"""Near twins, edit scripts and nearest keys against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import similarity
from corpuslens.operators import tokens as tk


def table(x, y):
    """Common lengths of all ends."""
    length = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if x[i] == y[j] else max(length[i + 1][j], length[i][j + 1])
    return length


def plain_script(x, y):
    length, i, j, out = table(x, y), 0, 0, []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(("same", x[i]))
            i, j = i + 1, j + 1
        elif i < len(x) and (j == len(y) or length[i + 1][j] >= length[i][j + 1]):
            out.append(("del", x[i]))
            i += 1
        else:
            out.append(("ins", y[j]))
            j += 1
    return out


def test_scripts_equal_the_whole_table():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 30, 80):
        for _ in range(40):
            x, y = ([rng.choice("abcd") for _ in range(rng.randrange(n + 1))] for _ in range(2))
            if rng.random() < 0.5:
                y = [w for w in x if rng.random() < 0.9]
            assert similarity.edit_script(x, y) == plain_script(x, y)
            assert similarity._common(x, y) == table(x, y)[0][0]


def test_scripts_of_long_texts_rebuild_both():
    rng = random.Random(2)
    x = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    y = [w for w in x if rng.random() < 0.98] + ["end"]
    steps = similarity.edit_script(x, y)
    assert [w for op, w in steps if op != "ins"] == x and [w for op, w in steps if op != "del"] == y
    assert sum(op == "same" for op, _ in steps) >= 0.97 * len(x)


@pytest.mark.parametrize("most, classes", [(2, False), (2, True), (1, False), (3, False)])
def test_twins_equal_comparing_all_pairs(spark, most, classes):
    rng = random.Random(most)
    base = [[rng.choice("aa bb cc dd ee ff".split()) for _ in range(rng.choice([3, 4, 5, 6, 9, 20]))] for _ in range(12)]
    texts = [*base]
    for ws in base * 5:
        ws = [*ws]
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(ws))
            ws[i : i + rng.randrange(2)] = [rng.choice(["aa", "zz", "bb"])] * rng.randrange(2)
        texts.append(ws)
    texts += [["the", "of", "and", "to"]] * 3 + [[]]
    df = spark.createDataFrame([(f"{i:03d}", 0, i, " ".join(ws)) for i, ws in enumerate(texts)], "pid string, grp long, ord long, text string")
    rows = [(f"{i:03d}", ws) for i, ws in enumerate(texts)]
    if classes:
        rows = [r for i, r in enumerate(rows) if r[1] not in [x for _, x in rows[:i]]]
    grams = lambda ws: {tuple(ws[i : i + 4]) for i in range(len(ws) - 3)}
    want = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            same = table(x, y)[0][0]
            if len(x) + len(y) - 2 * same <= most and same >= 3 and grams(x) & grams(y):
                want.add((a, b, same, len(x) + len(y) - 2 * same))
    got = [tuple(r) for r in similarity.near_twins(tk.tokens(df), most_changed=most, classes=classes).collect()]
    assert set(got) == want and len(got) == len(want)


def test_scripts_in_a_table(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    got = [[(o.op, o.word) for o in r.ops] if r.ops is not None else None for r in df.select(similarity.diff_operations(F.col("a"), F.col("b")).alias("ops")).collect()]
    assert got == [[("same", "a"), ("del", "b"), ("ins", "x"), ("same", "c")], [("ins", "a")], None]


def test_passages_with_their_words_are_not_taken_apart(spark):
    """Rows of whole passages give what their tokens give, and no words go through a shuffle to come together again."""
    rows = [(str(i), 0, i, t.split()) for i, t in enumerate(["aa bb cc dd ee", "aa bb cc dd ff", "aa bb cc dd ee", "xx yy", "aa bb cc dd ee aa bb cc"])]
    whole = spark.createDataFrame(rows, "pid string, grp long, ord long, ws array<string>")
    tokens = whole.select("pid", "grp", "ord", F.posexplode("ws").alias("pos", "key"))
    for made in (lambda t: similarity.near_twins(t, classes=True), similarity.equal_passages, lambda t: similarity.ngrams(t, 3), lambda t: similarity.distinct_ngrams(t, 3), similarity.phrase_bonds):
        got = made(whole)
        assert sorted(map(str, got.collect())) == sorted(map(str, made(tokens).select(got.columns).collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(similarity.distinct_ngrams(whole, 3)) and "collect_list" not in plan(similarity.equal_passages(whole))


@pytest.mark.parametrize("tile, density", [(7, 0.6), (64, 0.6), (1024, 0.02)])
def test_nearest_keys_equal_comparing_all_pairs(spark, tile, density):
    """Tiles of any size, filled or nearly empty, with ties; no row is made for each pair of keys that share a context."""
    rng = random.Random(tile)
    n = 200 if density < 0.1 else 60
    entries = {(f"k{i}", f"k{j}"): rng.choice([0.5, 1.0, 2.0]) for i in range(n) for j in range(n) if i != j and rng.random() < density}
    entries |= {("twin", o): w for (key, o), w in entries.items() if key == "k3"}
    df = spark.createDataFrame([(a, b, w, 1, 3, 5 if b < "k2" else 3) for (a, b), w in entries.items()], "key string, other string, w double, k long, df long, other_df long")
    rows = {}
    for (a, b), w in entries.items():
        rows.setdefault(a, {})[b] = w
    size = {a: sum(w * w for w in row.values()) ** 0.5 for a, row in rows.items()}
    want = []
    for a, x in rows.items():
        sims = [(b, sum(w * y.get(c, 0) for c, w in x.items()) / (size[a] * size[b])) for b, y in rows.items() if a != b]
        best = sorted((-round(s, 9), b) for b, s in sims if s >= 0.08)[:5]
        want += [(a, b, i + 1, -s, "syntagmatic" if (a, b) in entries else "paradigmatic") for i, (s, b) in enumerate(best)]
    near = similarity.nearest_keys(df, k=5, tile=tile)
    got = sorted((r.key, r.near, r.rank, r.sim, r.kind) for r in near.collect())
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in sorted(want)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)], abs=2e-9)
    assert "MapInArrow" in near._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_some_keys_are_those_of_all(spark):
    rng, words = random.Random(5), "bad cod fig hut jam lot map net pin red sun tip".split()
    df = spark.createDataFrame([(str(i), 0, i, " ".join(rng.choice(words) for _ in range(2))) for i in range(80)], "pid string, grp long, ord long, text string")
    every = similarity.ppmi(tk.tokens(df), most_share=0.6).collect()
    pairs = {(r.key, r.other): r for r in every}
    assert len(pairs) == len(every) > 0 and all(pairs[b, a].w == r.w and pairs[b, a].df == r.other_df for (a, b), r in pairs.items())
    some = similarity.ppmi(tk.tokens(df), most_share=0.6, only=["bd", "fg"]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in every if r.key in ("bd", "fg"))
