"""Scans in a total order over many parts."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators.ordered import last_before, numbered, running_sum


@pytest.mark.parametrize("n", [0, 1, 500])
def test_rows_are_numbered_over_parts(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), i) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v int, i long")
    order = sorted(rows, key=lambda r: (-r[1], r[2]))
    got = {r.i: r.nth for r in numbered(df, [F.desc("v"), F.col("i")], "nth", parts=7).collect()}
    assert got == {r[2]: j for j, r in enumerate(order)}
    within = {r.i: r.nth for r in numbered(df, [F.desc("v"), F.col("i")], "nth", "k", parts=7).collect()}
    want, seen = {}, {}
    for r in order:
        want[r[2]] = seen.get(r[0], 0)
        seen[r[0]] = want[r[2]] + 1
    assert within == want


@pytest.mark.parametrize("within", [None, "k"])
def test_sums_and_last_values_are_carried_over_parts(spark, within):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    sums = {r.i: r.s for r in running_sum(df.withColumn("n", F.coalesce("v", F.lit(0))), [F.col("i")], "n", "s", within, parts=7).collect()}
    lasts = {r.i: r.l for r in last_before(df, [F.desc("i")], "v", "l", within, parts=7).collect()}
    for k, i, _ in rows:
        same = [r for r in rows if within is None or r[0] == k]
        assert sums[i] == sum(r[2] or 0 for r in same if r[1] < i)
        assert lasts[i] == next((r[2] for r in same if r[1] > i and r[2] is not None), None)
