"""The graph, level by level, against a queue."""

import random

import pytest

from corpuslens.operators import graph
from corpuslens.operators import tokens as tk


def plain(passages, centre, levels, branch, stops, budget, rare_most=None, words=None, expanded=None):
    """passages: {pid: (grp, ord, words)}"""
    has = {}
    for pid, (_, _, ws) in passages.items():
        for w in set(ws):
            has.setdefault(w, set()).add(pid)
    own = set(passages[centre][2])
    nodes, links, visited, queue, left = {(centre, "passage", None, 0, None)}, [], {centre}, [("passage", centre, centre, 0)], budget
    while queue and left > 0:
        left -= 1
        kind, node, what, level = queue.pop(0)
        if level >= levels:
            left += 1
            continue
        if kind == "passage":
            for w in dict.fromkeys(w for w in passages[what][2] if w not in stops):
                if rare_most is not None and len(has[w]) > rare_most:
                    continue
                nodes.add((f"{w}@{what}", "word", what, level + 1, len(has[w])))
                links.append((what, f"{w}@{what}", "tree"))
                if words is None or (w, what) in words:
                    queue.append(("word", f"{w}@{what}", (w, what), level + 1))
        else:
            ranked = sorted((-len(own & set(passages[p][2])), passages[p][0], passages[p][1], p) for p in has[what[0]] if p != what[1])
            for shared, _, _, p in ranked[:branch]:
                if p in visited:
                    links.append((node, p, "loop"))
                    continue
                visited.add(p)
                nodes.add((p, "passage", node, level + 1, -shared))
                links.append((node, p, "tree"))
                if expanded is None or p in expanded:
                    queue.append(("passage", p, p, level + 1))
            if len(ranked) > branch and rare_most is None:
                nodes.add((f"more:{node}", "more", node, level + 1, len(ranked) - branch))
                links.append((node, f"more:{node}", "tree"))
    return nodes, sorted(links), left <= 0


@pytest.mark.parametrize("levels, branch, budget, rare", [(4, 2, 10_000, None), (5, 3, 40, None), (3, 1, 10_000, 6), (2, 50, 10_000, None), (6, 1, 9, None)])
def test_levels_equal_a_queue(spark, levels, branch, budget, rare):
    rng = random.Random(levels)
    passages = {f"{i % 4}:{i}": (i % 4, i, [rng.choice("aa bb cc dd ee ff gg hh ii jj kk".split()) for _ in range(rng.randrange(1, 6))]) for i in range(25)}
    df = spark.createDataFrame([(p, g, o, " ".join(ws)) for p, (g, o, ws) in passages.items()], "pid string, grp long, ord long, text string")
    grown = graph.grow(tk.tokens(df), "0:0", levels, branch=branch, budget=budget, stops=("kk",), rare_most=rare)
    nodes, links, truncated = plain(passages, "0:0", levels, branch, {"kk"}, budget, rare)
    assert {tuple(r) for r in grown.nodes.collect()} == nodes and grown.nodes.count() == len(nodes)
    assert sorted((r.source, r.target, r.kind) for r in grown.links.collect()) == links
    assert grown.truncated == truncated


def test_only_chosen_nodes_are_expanded(spark):
    passages = {"0:0": (0, 0, ["aa", "bb"]), "0:1": (0, 1, ["aa", "cc"]), "0:2": (0, 2, ["bb", "cc"]), "0:3": (0, 3, ["cc"])}
    df = spark.createDataFrame([(p, g, o, " ".join(ws)) for p, (g, o, ws) in passages.items()], "pid string, grp long, ord long, text string")
    words, expanded = {("aa", "0:0"), ("cc", "0:1")}, {"0:1"}
    grown = graph.grow(tk.tokens(df), "0:0", 4, words=spark.createDataFrame(list(words), "key string, pid string"), passages=spark.createDataFrame([(p,) for p in expanded], "pid string"))
    nodes, links, _ = plain(passages, "0:0", 4, 10, set(), 100, None, words, expanded)
    assert {tuple(r) for r in grown.nodes.collect()} == nodes and sorted((r.source, r.target, r.kind) for r in grown.links.collect()) == links


def test_a_centre_without_words(spark):
    df = spark.createDataFrame([("0:0", 0, 0, ""), ("0:1", 0, 1, "aa bb")], "pid string, grp long, ord long, text string")
    grown = graph.grow(tk.tokens(df), "0:0", 3)
    assert [r.id for r in grown.nodes.collect()] == ["0:0"] and grown.links.count() == 0 and not grown.truncated
