"""Compositions: term headers, occurrences with places, clusters, idioms, and all that is known of a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counts, expressions, search
from .tokens import mode_key, postings


def term_header(tokens: DataFrame, term: str, mode: str = "exact") -> DataFrame:
    """One row: the term's passages, tokens, commonest spelling, and how many spellings it has."""
    rows = tokens.where(mode_key(mode) == term)
    spelling = rows.groupBy("orig").agg(F.count("*").alias("n"), F.min(F.struct("grp", "ord", "pos")).alias("first"))
    head = rows.agg(F.countDistinct("pid").alias("passages"), F.count("*").alias("tokens"))
    return head.join(F.broadcast(spelling.agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "orig"))["orig"].alias("label"), F.count("*").alias("spellings")))).withColumn("term", F.lit(term))


def occurrences(tokens: DataFrame, term: str, mode: str = "exact", morphology: Column | None = None) -> DataFrame:
    """Passages of a term in reading order with its places, where an analysis satisfies a condition if one is given."""
    rows = tokens.where(mode_key(mode) == term)
    if morphology is not None:
        rows = rows.where(F.coalesce(morphology, F.lit(False)))
    return rows.groupBy("grp", "ord", "pid").agg(F.array_sort(F.collect_list("pos")).alias("positions")).orderBy("grp", "ord")


def occurrence_passages(found: DataFrame, spans: Column) -> DataFrame:
    """Passages of occurrences (pid, ...) with all places that they mark; spans is an array of places."""
    return found.select("pid", F.explode(spans).alias("i")).groupBy("pid").agg(F.array_sort(F.collect_set("i")).alias("positions"))


def run_span(start: Column, length: Column) -> Column:
    """The places of a run of words."""
    return F.sequence(start, start + length - 1)


def passages_by_group(found: DataFrame) -> DataFrame:
    """Distinct passages (pid, grp) by group."""
    return found.groupBy("grp").agg(F.countDistinct("pid").alias("passages"))


def verb_clusters(nouns: DataFrame) -> DataFrame:
    """Collocations by verb: its count and its nouns, commonest first."""
    return nouns.groupBy("verb").agg(F.sum("count").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "noun"))), lambda x: x["noun"]).alias("nouns"))


def idioms(tokens: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """Curated phrases, each a list of keys, where they occur: idiom, pid, start. One pass for each phrase of the list."""
    out = None
    for words in phrases:
        found = search.phrase(tokens, words, proclitics=True).withColumn("idiom", F.lit(" ".join(words)))
        out = found if out is None else out.unionByName(found)
    return out


def root_dossier(tokens: DataFrame, groups: DataFrame, root: str, neighbours: DataFrame, relations: DataFrame) -> DataFrame:
    """All that is known of a root, as rows of section, name and count."""
    row = lambda df, section, name, n: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), n.cast("double").alias("n"))
    own = tokens.where(F.col("root") == root)
    frames = expressions.frame_occurrences(tokens).where(F.col("root") == root).groupBy(F.concat_ws(" ", "head", "prep").alias("text")).agg(F.count("*").alias("n"))
    distribution = counts.distribution(tokens, groups, root, "root").where("n > 0")
    family = own.groupBy(F.coalesce("lemma", "key").alias("lemma")).agg(F.count("*").alias("n"))
    near = neighbours.where(F.col("key") == root)
    related = relations.where((F.col("a") == root) | (F.col("b") == root)).withColumn("other", F.when(F.col("a") == root, F.col("b")).otherwise(F.col("a")))
    return (
        row(distribution, "distribution", F.col("grp"), F.col("n")).unionByName(row(family, "derivation", F.col("lemma"), F.col("n")))
        .unionByName(row(frames, "frame", F.col("text"), F.col("n"))).unionByName(row(near, "neighbour", F.col("near"), F.col("sim")))
        .unionByName(row(related, "relation", F.col("other"), F.col("frames")))
        .unionByName(row(postings(own, "root").agg(F.count("*").alias("n")), "passages", F.lit(root), F.col("n")))
    )


def passage_shapes(tokens: DataFrame, term: str, mode: str = "exact") -> DataFrame:
    """The passages that have a term: pid, grp, ord, text, the positions that match, and each word's form, key, root, lemma and analysis."""
    word = F.struct("pos", F.col("orig").alias("form"), F.col("key").alias("normalized"), "root", "lemma", F.col("m").alias("morphology") if "m" in tokens.columns else F.lit(None).cast("string").alias("morphology"))
    rows = tokens.groupBy("pid", "grp", "ord").agg(F.array_sort(F.collect_list(word), lambda a, b: a["pos"] - b["pos"]).alias("words"), F.array_sort(F.collect_list(F.when(mode_key(mode) == term, F.col("pos")))).alias("matches"))
    return rows.where(F.size("matches") > 0).select("pid", "grp", "ord", F.array_join(F.transform("words", lambda w: w["form"]), " ").alias("text"), "matches", "words")
