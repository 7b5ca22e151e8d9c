"""Rows cut down to a budget against a plain loop; ragged cells; lookups in folders; files in splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import shaping
from corpuslens.sources import files, sinks

SCHEMA = "id long, title string, ui string, items array<struct<name:string,ui:string,tags:array<string>>>, notes array<string>, at struct<ui:string,page:int>"


def dumped(x):
    """JSON as Spark writes it: no nulls, no spaces."""
    def bare(v):
        if isinstance(v, dict):
            return {k: bare(w) for k, w in v.items() if w is not None}
        return [bare(w) for w in v] if isinstance(v, list) else v

    return json.dumps(bare(x), ensure_ascii=False, separators=(",", ":"))


def without(x, key):
    if isinstance(x, dict):
        return {k: without(v, key) for k, v in x.items() if k != key}
    return [without(v, key) for v in x] if isinstance(x, list) else x


def clipped(x, most):
    if isinstance(x, dict):
        return {k: clipped(v, most) for k, v in x.items()}
    if isinstance(x, list):
        return [clipped(v, most) for v in x]
    return f"{x[:most]}… [clipped: {len(x) - most} more characters]" if isinstance(x, str) and len(x) > most else x


def plain(row, most):
    if len(dumped(row)) <= most:
        return dumped(row), False
    out, budget = without(row, "ui"), max(shaping.LEAST, most - shaping.RESERVE)
    if len(dumped(out)) > budget:
        out = clipped(out, shaping.LONG)
    for _ in range(shaping.HALVINGS):
        lists = [(len(v), -i, k) for i, (k, v) in enumerate(out.items()) if isinstance(v, list)]
        if len(dumped(out)) <= budget or max(lists)[0] <= 1:
            break
        k = max(lists)[2]
        out[k] = out[k][: max(1, len(out[k]) // 2)]
    if len(dumped(out)) > budget:
        out = clipped(out, shaping.SHORT)
    return dumped(out), True


def test_rows_equal_a_plain_loop(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé \"\n") for _ in range(rng.randrange(n)))
    rows = []
    for i in range(60):
        items = [{"name": word(rng.choice([5, 50, 900])), "ui": word(20), "tags": [word(8) for _ in range(rng.randrange(4))]} for _ in range(rng.choice([0, 1, 3, 40, 200]))]
        rows.append({"id": i, "title": word(rng.choice([5, 9000])), "ui": rng.choice([None, "link"]), "items": rng.choice([items, items, None]) if i else None, "notes": [word(rng.choice([10, 6000])) for _ in range(rng.choice([0, 2, 30]))], "at": rng.choice([None, {"ui": "x", "page": i}])})
    for most in (500, 3000, 20_000):
        got = shaping.fit_to_budget(spark.createDataFrame(rows, SCHEMA), most).collect()
        for row, r in zip(rows, got, strict=True):
            row = {k: v for k, v in row.items()}
            want = plain({k: v for k, v in row.items() if v is not None}, most)
            assert (r.text, r.truncated) == want and bool(r.removed) == r.truncated
    assert shaping.fit_to_budget(spark.createDataFrame([(1, "a" * 5000)], "id int, t string"), 1000).first().removed == ["fields named ui", "text beyond 4000 characters", "text beyond 400 characters"]


def test_ragged_rows_have_a_cell_for_every_key(spark, tmp_path):
    rows = [(0, '{"b": 1, "a": [1, "x y", null]}'), (1, '{"c\'d": {"e": [1]}, "a": "q\\"x"}'), (2, None), (3, "no json"), (4, '{"b": null, "z": 1.5, "ü": true}')]
    wide = sinks.spread(spark.createDataFrame(rows, "id int, props string"), "props", [F.col("id")])
    assert wide.columns == ["id", "b", "a", "c'd", "z", "ü"]
    got = [tuple(r) for r in wide.orderBy("id").collect()]
    assert got[0][:3] == (0, "1", "1 x y null") or got[0][:3] == (0, "1", "1 x y ")
    assert got[1][2:4] == ('q"x', '{"e":[1]}') and got[2] == (2, None, None, None, None, None) == (2, *got[3][1:])
    assert got[4][4:] == ("1.5", "true")
    sinks.write_csv(wide.coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()[0] == "id,b,a,c'd,z,ü"
    with pytest.raises(ValueError):
        sinks.spread(spark.createDataFrame([(1, '{"id": 2}')], "id int, props string"), "props", [F.col("id")])
    assert sinks.spread(spark.createDataFrame([], "id int, props string"), "props", [F.col("id")]).columns == ["id"]


def test_lookups_read_the_folders_asked_for(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 50}", i) for i in range(200)], "key string, n int")
    sinks.write_shards(df, str(tmp_path / "s"), "key")
    asked = spark.createDataFrame([("k3",), ("k7",), ("k3",), ("none",), (None,)], "key string")
    found = sinks.look_up(spark, str(tmp_path / "s"), "key", asked)
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"k{i % 50}", i) for i in range(200) if i % 50 in (3, 7))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and "ReadSchema" in plan
    assert sinks.look_up(spark, str(tmp_path / "s"), "key", asked.where("key = 'zz'")).count() == 0


def test_lines_and_entries_of_files_in_splits(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for f in range(3):
        rows = [("# " + rng.choice("كتب درس نور قول علم فهم".split())) if rng.random() < 0.1 else "".join(rng.choice("ab ") for _ in range(rng.randrange(60))) for _ in range(400)]
        rows = [r + "\r" if f == 1 else r for r in rows]
        (tmp_path / f"f{f}.txt").write_text("\n".join(rows) + ("\n" if f else ""))
        want[f"f{f}.txt"] = [r.rstrip("\r") for r in rows]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "*.txt")).rdd.getNumPartitions() > 20
        lines = files.read_lines(spark, str(tmp_path / "*.txt"))
        entries = files.open_entries(lines, F.col("value").startswith("#")).collect()
        found = files.dictionary_entries(lines, "bare").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    got = {}
    for r in entries:
        got.setdefault(r.file.rsplit("/", 1)[-1], {})[r.line] = (r.value, r.entry)
    for name, rows in want.items():
        assert [got[name][i][0] for i in range(len(rows))] == rows and len(got[name]) == len(rows)
        last = None
        for i, row in enumerate(rows):
            last = i if row.startswith("#") else last
            assert got[name][i][1] == last
    for name, rows in want.items():
        first, root, body = {}, None, []
        for row in [*rows, "# END"]:
            if row.startswith("#"):
                text = " ".join(" ".join(body).split())
                if root and len(text) >= 4:
                    first.setdefault(root, text)
                root, body = row[2:], []
            else:
                body.append(row)
        assert {r.root: r.full for r in found if r.file.endswith(name)} == first
