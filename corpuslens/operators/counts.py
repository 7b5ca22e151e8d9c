"""Distributions, catalogues and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import mode_key, postings, without_stops


def distribution(tokens: DataFrame, groups: DataFrame, term: str, mode: str = "exact") -> DataFrame:
    """grp and the term's tokens in it, for every group, those without the term too."""
    found = tokens.where(mode_key(mode) == term).groupBy("grp").agg(F.count("*").alias("n"))
    return groups.select("grp").distinct().join(found, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"))


def key_frequency(tokens: DataFrame, column: str = "root") -> DataFrame:
    """key, its tokens and distinct passages; tokens without the annotation don't count."""
    per_passage = tokens.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"), "pid").agg(F.count("*").alias("n"))
    return per_passage.groupBy("key").agg(F.sum("n").alias("tokens"), F.count("*").alias("passages"))


def word_frequency(counted: DataFrame) -> DataFrame:
    """key, its tokens and passages, of word_counts: one shuffle, of what each task has of a word."""
    return counted.groupBy("key").agg(F.sum("n").alias("tokens"), F.count("*").alias("passages"))


def hapax(tokens: DataFrame, column: str = "root") -> DataFrame:
    """key and passage of the keys that occur once."""
    return tokens.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"), F.min("pid").alias("pid")).where("n = 1").select("key", "pid")


def corpus_stats(passages: DataFrame, tokens: DataFrame) -> DataFrame:
    p = passages.agg(F.countDistinct("grp").alias("groups"), F.count("*").alias("passages"))
    t = tokens.agg(F.count("*").alias("words"), F.approx_count_distinct("key").alias("_"))
    distinct = [tokens.where(F.col(c).isNotNull()).select(c).distinct().agg(F.count("*").alias(name)) for c, name in (("key", "forms"), ("root", "roots"), ("lemma", "lemmas"))]
    out = p.join(t.drop("_"), how="full", on=F.lit(True))
    for d in distinct:
        out = out.join(d, how="full", on=F.lit(True))  # one row each
    return out


def coverage(tokens: DataFrame) -> DataFrame:
    share = lambda c: (F.sum(F.col(c).isNotNull().cast("long")) / F.count("*"))
    return tokens.agg(F.count("*").alias("tokens"), F.sum(F.col("root").isNotNull().cast("long")).alias("rooted"), share("root").alias("root_share"), share("lemma").alias("lemma_share"))


def field_stats(tokens: DataFrame, roots: list[str]) -> DataFrame:
    """Tokens and distinct passages of a semantic field: by root, by group, and in all (level)."""
    found = tokens.where(F.col("root").isin(*roots)).groupBy("root", "grp", "pid").agg(F.count("*").alias("n"))
    cube = found.groupingSets([["root"], ["grp"], []], "root", "grp").agg(F.sum("n").alias("tokens"), F.countDistinct("pid").alias("passages"), F.grouping_id("root", "grp").alias("g"))
    return cube.select(F.when(F.col("g") == 1, "root").when(F.col("g") == 2, "group").otherwise("all").alias("level"), "root", "grp", "tokens", "passages")


def group_profile(tokens: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages, words, distinct roots, and refrains (passages whose words another of the group repeats, of two words at least) of each group."""
    words = tokens.groupBy("grp").agg(F.count("*").alias("words"), F.countDistinct("root").alias("roots"))
    sizes = passages.groupBy("grp").agg(F.count("*").alias("passages"))
    texts = tokens.groupBy("grp", "pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("ws")).where(F.size("ws") >= 2)
    repeated = texts.groupBy("grp", F.array_join("ws", " ").alias("line")).agg(F.count("*").alias("n")).where("n >= 2")
    refrains = repeated.groupBy("grp").agg(F.count("*").alias("refrains"), F.sum("n").alias("refrain_passages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sizes.join(words, "grp", "left").join(refrains, "grp", "left").select("grp", "passages", *map(zero, ("words", "roots", "refrains", "refrain_passages")))


def passage_profile(tokens: DataFrame, rarest: int = 5) -> DataFrame:
    """Words, letters, distinct roots, roots of this passage alone, and the rarest roots of each passage."""
    roots = postings(tokens.where("root is not null").withColumn("key", F.col("root")))
    df = roots.groupBy("key").agg(F.count("*").alias("df"))
    rare = roots.join(df, "key").withColumn("n", F.row_number().over(Window.partitionBy("pid").orderBy("df", "key")))
    marked = rare.groupBy("pid").agg(F.count("*").alias("roots"), F.sum((F.col("df") <= 1).cast("long")).alias("unique_roots"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= rarest, F.struct("n", "key")))), lambda x: x["key"]), " ").alias("rarest"))
    words = tokens.groupBy("pid").agg(F.count("*").alias("words"), F.sum(F.length("key")).alias("letters"))
    return words.join(marked, "pid", "left").select("pid", "words", "letters", F.coalesce("roots", F.lit(0)).alias("roots"), F.coalesce("unique_roots", F.lit(0)).alias("unique_roots"), F.coalesce("rarest", F.lit("")).alias("rarest"))


def dominant_ending(ends: DataFrame) -> DataFrame:
    """The commonest ending of each group's passages (grp, ending), of equally common ones the one that comes first; n is how many have it."""
    counted = ends.where("ending is not null").groupBy("grp", "ending").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.groupBy("grp").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "ending", "n")).alias("x")).select("grp", "x.ending", "x.n")


def passage_analyses(tokens: DataFrame) -> DataFrame:
    """Word classes with their counts, in fixed order, and the verb forms of each passage of analysed tokens."""
    # fixed values: the order in which classes are shown
    order = ("noun", "verb", "particle", "pn", "pron", "adj", "actpcpl", "passpcpl")
    counted = tokens.groupBy("pid").agg(*[F.count(F.when(F.col("m.pos") == p, 1)).alias(p) for p in order], F.sort_array(F.collect_set(F.when(F.col("m.vf") > 0, F.col("m.vf")))).alias("forms"))
    mix = F.filter(F.array(*[F.struct(F.lit(p).alias("pos"), F.col(p).alias("count")) for p in order]), lambda x: x["count"] > 0)
    return counted.select("pid", mix.alias("pos_mix"), "forms")


def letter_profile(tokens: DataFrame, group, top: int = 10) -> DataFrame:
    """The letters most over-represented in a group: its count, share, the corpus's share and their ratio."""
    per = tokens.groupBy((F.col("grp") == group).alias("own"), "key").agg(F.count("*").alias("n")).select("own", "n", F.explode(F.split("key", "")).alias("letter")).where("letter != ''")
    counts = per.groupBy("letter").agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("count"), F.sum("n").alias("all"))
    both = counts.join(F.broadcast(counts.agg(F.sum("count").alias("own_total"), F.sum("all").alias("total"))))  # one row
    rows = both.select("letter", "count", (F.col("count") / F.col("own_total")).alias("share"), (F.col("all") / F.col("total")).alias("corpus_share"))
    return rows.withColumn("ratio", F.col("share") / F.col("corpus_share")).where("count > 0").orderBy(F.desc(F.round("ratio", 9)), "letter").limit(top)


def pairing(tokens: DataFrame, rows: list[str], columns: list[str], mode: str = "exact") -> DataFrame:
    """Passages that each pair of terms shares, pairs without any too, with each term's own passages (df_row, df_col)."""
    spark = tokens.sparkSession
    found = postings(tokens, mode).where(F.col("key").isin(*rows, *columns))
    term = lambda ts, n: spark.createDataFrame([(t, i) for i, t in enumerate(ts)], f"{n} string, {n}_i int")
    grid = term(rows, "row").join(term(columns, "col"))  # two short lists of parameters
    together = found.select(F.col("key").alias("row"), "pid").join(found.select(F.col("key").alias("col"), "pid"), "pid").groupBy("row", "col").agg(F.count("*").alias("n"))
    df = found.groupBy("key").agg(F.count("*").alias("df"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = grid.join(together, ["row", "col"], "left").join(df.select(F.col("key").alias("row"), F.col("df").alias("df_row")), "row", "left").join(df.select(F.col("key").alias("col"), F.col("df").alias("df_col")), "col", "left")
    return out.select("row", "col", "row_i", "col_i", *map(zero, ("n", "df_row", "df_col")))


def pairing_pairs(grid: DataFrame) -> DataFrame:
    """The pairs of a grid without its diagonal and mirrors, commonest first."""
    pairs = grid.where("row != col").withColumn("a", F.least("row", "col")).withColumn("b", F.greatest("row", "col"))
    return pairs.dropDuplicates(["a", "b"]).select("a", "b", "n").orderBy(F.desc("n"), "a", "b")


def morphology_catalogue(tokens: DataFrame, where: Column, mode: str = "exact") -> DataFrame:
    """The keys whose tokens' analyses satisfy a condition: count, passages and first spelling."""
    rows = tokens.where(F.col("m").isNotNull() & where)
    at = F.struct("grp", "ord", "pos")
    return rows.groupBy(mode_key(mode).alias("key")).agg(F.count("*").alias("count"), F.countDistinct("pid").alias("passages"), F.sort_array(F.collect_set(F.struct("grp", "ord", "pid"))).alias("at"), F.min_by("orig", at).alias("label"))


def morphology_filter(**axes: list) -> Column:
    """A condition on the analysis m: any of the values of an axis, on all axes; a token without analysis fails."""
    out = F.col("m").isNotNull()
    for axis, values in axes.items():
        if values:
            out = out & F.coalesce(F.col(f"m.{axis}").isin(*values), F.lit(False))
    return out


def derivation_family(tokens: DataFrame, root: str) -> DataFrame:
    """The lemmas of a root: count, up to eight spellings in order of appearance, passages, and the first analysis with a part of speech."""
    at = F.struct("grp", "ord", "pos")
    rows = tokens.where(F.col("root") == root)
    order = {"verb": 0, "noun": 1, "adj": 2, "actpcpl": 3, "passpcpl": 4, "pn": 5}
    agg = rows.groupBy(F.coalesce("lemma", "key").alias("lemma")).agg(
        F.count("*").alias("count"), F.countDistinct("pid").alias("passages"),
        F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("grp", "ord", "pos", "orig"))), lambda x: x["orig"])), 1, 8).alias("spellings"),
        F.coalesce(F.min_by("m", F.when(F.col("m.pos").isNotNull(), at)), F.min_by("m", at)).alias("m"))
    rank = F.coalesce(*[F.when(F.col("m.pos") == p, F.lit(i)) for p, i in order.items()], F.lit(9))
    return agg.withColumn("class_rank", rank).orderBy("class_rank", "m.vf", F.desc("count"), "lemma")


def name_counts(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Passages of each name's form and of its root; names has (name, norm, root)."""
    df = lambda key, out: tokens.where(F.col(key).isNotNull()).select(key, "pid").distinct().groupBy(key).agg(F.count("*").alias(out))
    return names.join(df("key", "form_df").withColumnRenamed("key", "norm"), "norm", "left").join(df("root", "root_df"), "root", "left").select("name", "norm", "root", F.coalesce("form_df", F.lit(0)).alias("form_df"), F.coalesce("root_df", F.lit(0)).alias("root_df"))


def tag_counts(assigned: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Passages of each tag of (pid, tag), in all or among given passages."""
    rows = assigned if within is None else assigned.join(within.select("pid").distinct(), "pid", "left_semi")
    return rows.groupBy("tag").agg(F.countDistinct("pid").alias("passages"))


def merge_workspaces(old: DataFrame, new: DataFrame) -> DataFrame:
    """Claims of two workspaces (id, body, tags, updated): the later body of an id counts, its tags are united."""
    both = old.unionByName(new)
    return both.groupBy("id").agg(F.max_by("body", "updated").alias("body"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.max("updated").alias("updated"))


def shared_passages(tokens: DataFrame, terms: list[str], mode: str = "exact") -> DataFrame:
    """Passages that have all of the terms."""
    found = postings(tokens, mode).where(F.col("key").isin(*terms))
    return found.groupBy("pid", "grp", "ord").agg(F.count("*").alias("n")).where(F.col("n") == len(set(terms))).select("pid", "grp", "ord")


def top_per_group(tokens: DataFrame, stops: tuple[str, ...], k: int = 3) -> DataFrame:
    counts = without_stops(tokens, stops).groupBy("grp", "key").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= k)


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the ordered rows, with the number of all (total) and whether more follow."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(min(limit, 500)).join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + min(limit, 500))
