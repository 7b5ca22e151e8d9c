"""Quotations in a running text against going through the text from every word."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import quotes
from corpuslens.operators.search import locate_across


def plain(passages, words, joined):
    """{(grp, place): [(pid, at, count)]} by trying every word as the first."""
    out, groups = {}, {}
    for pid, grp, ord_, ws in passages:
        groups.setdefault(grp, []).append((ord_, pid, ws))
    for grp, rows in groups.items():
        text = [(pid, i, ks) for _, pid, ws in sorted(rows, key=lambda r: r[:2]) for i, ks in enumerate(ws)]
        for start in range(len(text)):
            j, at = 0, start
            while j < len(words) and at < len(text):
                ks = set(text[at][2])
                if ks & set(words[j]):
                    j += 1
                elif ks & set(joined[j]):
                    j += 2
                else:
                    break
                at += 1
            if j == len(words):
                cover = {}
                for pid, i, _ in text[start:at]:
                    cover.setdefault(pid, []).append(i)
                out[grp, start] = sorted((pid, min(x), len(x)) for pid, x in cover.items())
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_places_equal_trying_every_word(spark, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK", block)
    rng = random.Random(block)
    letters = ["a", "b", "c", "ab", "bc", "ca", "aa"]
    word = lambda: [rng.choice(letters)] + ([rng.choice(letters)] if rng.random() < 0.2 else [])
    passages = [(f"p{i}", rng.choice(["hot", "hot", "g", None]), i, [word() for _ in range(rng.randrange(0, 9))]) for i in range(40)]
    text = quotes.running_text(spark.createDataFrame(passages, "pid string, grp string, ord long, words array<array<string>>"), F.col("words"))
    asked = []
    for q in range(60):
        ws = [rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 3, 4, 5, 7]))]
        asked.append((q, [[w] + (["zz"] if rng.random() < 0.3 else []) for w in ws], [[a + b] for a, b in zip(ws, ws[1:])] + [[]]))
    got = {}
    for r in quotes.locate_quotations(text, spark.createDataFrame(asked, "qid long, words array<array<string>>, joined array<array<string>>")).collect():
        got.setdefault(r.qid, {}).setdefault((r.grp, r.place), []).append((r.pid, r["at"], r["count"]))
    for q, words, joined in asked:
        assert {k: sorted(v) for k, v in got.get(q, {}).items()} == plain(passages, words, joined), (words, joined)


def test_one_quotation_equals_the_windowed_search(spark):
    passages = spark.createDataFrame([("1:1", 1, 1, "in the name"), ("1:2", 1, 2, "of peace oh you"), ("1:3", 1, 3, "ohyou people"), ("2:1", 2, 1, "of peace")], "pid string, grp long, ord long, text string")
    words = F.transform(F.split("text", " "), lambda w: F.array(w))
    text = quotes.running_text(passages, words)
    given = spark.createDataFrame([(1, "peace oh you oh you"), (2, "name of"), (3, "peace"), (4, "people of"), (5, "")], "qid long, text string")
    asked = quotes.quotations(given, F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.array(w))
    places = quotes.locate_quotations(text, asked)
    got = sorted((r.qid, r.pid, r.positions, r.whole) for r in quotes.quoted_passages(places).collect())
    assert got == [(1, "1:2", [1, 2, 3], False), (1, "1:3", [0], False), (2, "1:1", [2], False), (2, "1:2", [0], False), (3, "1:2", [1], False), (3, "2:1", [1], False)]
    tokens = passages.select("pid", "grp", "ord", F.posexplode(words).alias("pos", "quote_keys"))
    assert [tuple(r) for r in locate_across(tokens, [["peace"], ["oh"], ["you"], ["oh"], ["you"]]).collect()] == [(1, 2, "1:2", 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pid string, grp long, ord long, words array<array<string>>")
    asked = spark.createDataFrame([(1, [["a"]], [[]])], "qid long, words array<array<string>>, joined array<array<string>>")
    assert quotes.locate_quotations(quotes.running_text(none, F.col("words")), asked).collect() == []


def test_the_text_meets_few_quotations_without_a_shuffle(spark):
    """Even where Spark broadcasts nothing by itself, only the blocks that may hold a place are dealt out."""
    df = spark.createDataFrame([(str(i), "g", i, "some words that stand here and there".split()) for i in range(40)] + [("90", "g", 90, "a line to quote".split())], "pid string, grp string, ord long, ws array<string>")
    alone = lambda w: F.array(w)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = quotes.quotations(spark.createDataFrame([(1, "line to quote".split())], "qid long, ws array<string>"), F.col("ws"), alone)
        places = quotes.locate_quotations(quotes.running_text(df, F.transform("ws", alone)), asked)
        assert "BroadcastHashJoin" in places._jdf.queryExecution().executedPlan().toString()
        assert [(r.pid, r.at, r["count"]) for r in places.collect()] == [("90", 1, 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
