"""Collocations, neighbours and keyness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.association import association

from .tokens import mode_key, postings, without_stops


def _scored(joint: DataFrame, n: DataFrame) -> DataFrame:
    """Adds the measures to (key, k, a, b); n is one row (n)."""
    scored = joint.join(F.broadcast(n)).withColumn("s", association("k", "a", "b", "n"))
    return scored.select("key", F.col("k").alias("count"), "b", F.col("s.pmi").alias("pmi"), F.col("s.ll").alias("ll"), F.col("s.log_dice").alias("log_dice"), F.col("s.tier").alias("tier"))


def collocations(tokens: DataFrame, term: str, mode: str = "exact", stops: tuple[str, ...] = ()) -> DataFrame:
    """Keys that share passages with the term: how many, their own, and the measures over passages."""
    own = tokens.where(mode_key(mode) == term).select("pid").distinct()
    kept = postings(without_stops(tokens, stops, mode).where(mode_key(mode) != term), mode)
    df = kept.groupBy("key").agg(F.count("*").alias("b"))
    joint = kept.join(own, "pid", "left_semi").groupBy("key").agg(F.count("*").alias("k"))
    a = own.agg(F.count("*").alias("a"))
    return _scored(joint.join(df, "key").join(F.broadcast(a)), tokens.select("pid").distinct().agg(F.count("*").alias("n")))


def windowed_collocations(tokens: DataFrame, term: str, window: int, side: str = "both", mode: str = "exact", stops: tuple[str, ...] = ()) -> DataFrame:
    """Tokens within so many words of the term's tokens, with the measures over tokens. A join by passage of the term's tokens alone."""
    key = mode_key(mode)
    lo, hi = {"both": (-window, window), "left": (-window, -1), "right": (1, window)}[side]
    anchors = tokens.where(key == term).select("pid", F.col("pos").alias("at"))
    near = without_stops(tokens, stops, mode).where(key != term).select("pid", "pos", key.alias("key"))
    joint = near.join(anchors, "pid").where((F.col("pos") - F.col("at")).between(lo, hi)).groupBy("key").agg(F.count("*").alias("k"))
    freq = tokens.groupBy(key.alias("key")).agg(F.count("*").alias("b"))
    a = tokens.where(key == term).agg(F.count("*").alias("a"))
    return _scored(joint.join(freq, "key").join(F.broadcast(a)), tokens.agg(F.count("*").alias("n")))


def neighbours(tokens: DataFrame, term: str, mode: str = "exact", across: bool = False) -> DataFrame:
    """Words directly before and after the term; with ``across`` also over the border of passages that follow one another."""
    key = mode_key(mode)
    if across:
        w = Window.partitionBy("grp").orderBy("ord", "pos")
    else:
        w = Window.partitionBy("grp", "pid").orderBy("pos")
    rows = tokens.select("grp", "pid", "ord", "pos", key.alias("key"))
    joined = lambda f: F.when(F.abs(f("ord").over(w) - F.col("ord")) <= 1, f("key").over(w))
    hit = rows.select("key", joined(F.lag).alias("before"), joined(F.lead).alias("after")).where(F.col("key") == term)
    sides = hit.select(F.explode(F.array(F.struct(F.col("before").alias("key"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.col("after").alias("key"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x"))
    return sides.where(F.col("x.key").isNotNull() & (F.col("x.key") != term)).groupBy("x.key").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"), F.count("*").alias("total"))


def compare(tokens: DataFrame, one: str, two: str, mode: str = "exact", stops: tuple[str, ...] = ()) -> DataFrame:
    """The collocates of two terms: key, its counts with either, and which has it (shared, one, two)."""
    a, b = (collocations(tokens, t, mode, stops).select("key", F.col("count").alias(c)) for t, c in ((one, "count_one"), (two, "count_two")))
    both = a.join(b, "key", "full")
    side = F.when(F.col("count_one").isNull(), "two").when(F.col("count_two").isNull(), "one").otherwise("shared")
    return both.select("key", F.coalesce("count_one", F.lit(0)).alias("count_one"), F.coalesce("count_two", F.lit(0)).alias("count_two"), side.alias("side"))


def keyness(tokens: DataFrame, group=None, column: str = "root", least: int = 2, stops: tuple[str, ...] = ()) -> DataFrame:
    """Keys that a group's passages have oftener than the corpus: count in it, df, and positive log-likelihood; of one group or all."""
    rows = postings(without_stops(tokens, stops).where(F.col(column).isNotNull()).withColumn("key", F.col(column)))
    df = rows.groupBy("key").agg(F.count("*").alias("df"))
    passages = tokens.select("grp", "pid").distinct()
    sizes = passages.groupBy("grp").agg(F.count("*").alias("size"))
    n = passages.agg(F.count("*").alias("n"))
    own = (rows if group is None else rows.where(F.col("grp") == group)).groupBy("grp", "key").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    scored = own.join(df, "key").join(sizes, "grp").join(F.broadcast(n)).withColumn("ll", association("count", "size", "df", "n")["ll"])
    return scored.where("ll > 0").select("grp", "key", "count", "df", "ll")


def top_keys(keys: DataFrame, k: int = 25) -> DataFrame:
    """The k keys of each group with the greatest keyness."""
    return keys.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("ll", 9)), "key"))).where(F.col("rank") <= k)


def compare_keys(keys: DataFrame, one, two, k: int = 24) -> DataFrame:
    """The top keys of two groups and which of them has each."""
    top = top_keys(keys.where(F.col("grp").isin(one, two)), k)
    sides = top.groupBy("key").agg(F.collect_set("grp").alias("grps"))
    return sides.select("key", F.when(F.size("grps") == 2, "both").when(F.array_contains("grps", one), "one").otherwise("two").alias("side"))
