"""Multi-word expressions: governed frames, collocations, genitive chains and constructions. Tokens have the struct m."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.association import association

from .morphology import GOVERNORS, definite

# Parts of speech that a preposition may be governed by, and those of nouns in chains and collocations.
HEADS = ("verb", "noun", "actpcpl", "passpcpl")
NOUNS = ("noun", "pn", "actpcpl", "passpcpl")


def _w():
    return Window.partitionBy("pid").orderBy("pos")


def governing(tokens: DataFrame, governors: tuple[str, ...] = GOVERNORS) -> DataFrame:
    """Tokens with prep and det from their segments; where these aren't known, a preposition is a word of its own and an article is a written one."""
    prep = F.col("prep") if "prep" in tokens.columns else F.when(F.col("norm").isin(*governors), F.col("norm"))
    det = F.coalesce(F.col("det"), F.lit(False)) if "det" in tokens.columns else F.col("norm").startswith("ال")
    return tokens.withColumn("prep", prep).withColumn("det", det)


def _content(parts: tuple[str, ...], m: Column | str = "m") -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.coalesce(m["pos"].isin(*parts) & m["root"].isNotNull(), F.lit(False))


def frame_occurrences(tokens: DataFrame, governors: tuple[str, ...] = GOVERNORS) -> DataFrame:
    """pid, head, its part of speech, preposition and both places: the head is the nearest verb or common noun with a root up to two words before.

    The preposition is that of a word's segments, so one written as one with its word is found at that word.
    """
    head = F.when(_content(HEADS), F.struct("m.lemma", "m.pos", "m.root", F.col("pos").alias("at")))
    rows = governing(tokens, governors).select("pid", "grp", "ord", "pos", "prep", F.last(head, ignorenulls=True).over(_w().rowsBetween(-2, -1)).alias("h"))
    return rows.where(F.col("prep").isNotNull() & F.col("h").isNotNull()).select("pid", "grp", "ord", F.col("h.lemma").alias("head"), F.col("h.pos").alias("head_pos"), F.col("h.root").alias("root"), "prep", F.col("h.at").alias("head_idx"), F.col("pos").alias("prep_idx"))


def frames(occurrences: DataFrame, least: int = 2) -> DataFrame:
    return occurrences.groupBy("head", "head_pos", "root", "prep").agg(F.count("*").alias("count")).where(F.col("count") >= least)


def head_totals(tokens: DataFrame) -> DataFrame:
    return tokens.where(_content(HEADS)).groupBy(F.col("m.lemma").alias("head"), F.col("m.pos").alias("head_pos")).agg(F.count("*").alias("total"))


def frame_contrast(frames_: DataFrame, totals: DataFrame) -> DataFrame:
    """A head's counts by preposition, with what is left of its total as bare."""
    governed = frames_.groupBy("head", "head_pos").agg(F.sum("count").alias("governed"))
    bare = governed.join(totals, ["head", "head_pos"]).select("head", "head_pos", F.lit("").alias("prep"), F.greatest(F.lit(0), F.col("total") - F.col("governed")).alias("count"))
    return frames_.select("head", "head_pos", "prep", "count").unionByName(bare)


def verb_nouns(tokens: DataFrame, governors: tuple[str, ...] = GOVERNORS, least: int = 3, top: int = 700) -> DataFrame:
    """Verbs with the noun among the three words after them that nothing but pronouns and particles parts from them and no preposition governs: counts and association over such slots."""
    ahead = F.collect_list(F.struct("m", "prep")).over(_w().rowsBetween(1, 3))
    stops = lambda x: x["prep"].isNotNull() | ~F.coalesce(x["m"]["pos"].isin("pron", "particle"), F.lit(False))
    slots = governing(tokens, governors).select("pid", "m", ahead.alias("ahead")).where(_content(("verb",))).select("pid", F.col("m.lemma").alias("verb"), F.col("m.root").alias("verb_root"), F.try_element_at(F.filter("ahead", stops), F.lit(1)).alias("n"))
    pairs = slots.where(F.col("n.prep").isNull() & _content(NOUNS, F.col("n.m"))).select("verb", "verb_root", F.col("n.m.lemma").alias("noun"), F.col("n.m.root").alias("noun_root"))
    total = pairs.agg(F.count("*").alias("n"))
    a, b = (pairs.groupBy(c).agg(F.count("*").alias(n)) for c, n in (("verb", "a"), ("noun", "b")))
    joint = pairs.groupBy("verb", "verb_root", "noun", "noun_root").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    scored = joint.join(a, "verb").join(b, "noun").join(F.broadcast(total)).withColumn("s", association("count", "a", "b", "n"))
    return scored.select("verb", "verb_root", "noun", "noun_root", "count", F.col("s.ll").alias("ll"), F.col("s.log_dice").alias("log_dice")).orderBy(F.desc("ll"), "verb", "noun").limit(top)


def genitive_chains(tokens: DataFrame, governors: tuple[str, ...] = GOVERNORS, least: int = 2, top: int = 800) -> DataFrame:
    """Chains of a noun without article or preposition and the genitive nouns without preposition that follow it, each as long as it goes: lemmas, words, count, occurrences."""
    noun = _content(NOUNS)
    after_noun = F.coalesce(F.lag(noun).over(_w()), F.lit(False)) & F.coalesce(F.col("m.gcase") == "gen", F.lit(False))
    free = F.col("prep").isNull()
    rows = governing(tokens, governors).select("pid", "pos", F.col("m.lemma").alias("lemma"), noun.alias("noun"), (noun & after_noun & free).alias("on"), (free & ~F.col("det") & ~after_noun).alias("open"))
    chains = rows.withColumn("chain", F.sum((~F.col("on")).cast("int")).over(_w())).where("noun").groupBy("pid", "chain").agg(F.array_sort(F.collect_list(F.struct("pos", "lemma", "open"))).alias("ws"))
    good = chains.where((F.size("ws") >= 2) & F.col("ws")[0]["open"]).select(F.array_join(F.transform("ws", lambda x: x["lemma"]), " ").alias("lemmas"), F.size("ws").alias("n_words"), F.struct("pid", F.col("ws")[0]["pos"].alias("start")).alias("at"))
    return good.groupBy("lemmas", "n_words").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("at")).alias("occurrences")).where(F.col("count") >= least).orderBy(F.desc("count"), F.desc("n_words"), "lemmas").limit(top)


def valency(frames_: DataFrame, totals: DataFrame, nouns: DataFrame) -> DataFrame:
    """root, preps, governed, bare, objects and object_total of every root with frames or collocations.

    preps: the prepositions of all heads of the root, added up, commonest first; governed: their sum; bare: what these leave
    of the heads' totals (none where frames are more); objects: the nouns it goes with, commonest first; object_total: their
    sum. Ties go by preposition and by noun.
    """
    heads = frames_.where("root is not null").select("root", "head", "head_pos").distinct()
    rows = frames_.groupBy("head", "head_pos", "prep").agg(F.sum("count").alias("count"))
    left = frame_contrast(rows, totals).where("prep = ''").select("head", "head_pos", F.col("count").alias("bare"))
    bare = heads.join(left, ["head", "head_pos"], "left").groupBy("root").agg(F.coalesce(F.sum("bare"), F.lit(0)).alias("bare"))
    per = heads.join(rows, ["head", "head_pos"]).groupBy("root", "prep").agg(F.sum("count").alias("count"))
    ranked = lambda name: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), name, "count"))), lambda x: F.struct(x[name].alias(name), x["count"].alias("count")))
    preps = per.groupBy("root").agg(ranked("prep").alias("preps"), F.sum("count").alias("governed"))
    both = nouns.select(F.explode(F.array_distinct(F.array_compact(F.array("verb_root", "noun_root")))).alias("root"), "noun", "count")
    objects = both.groupBy("root").agg(ranked("noun").alias("objects"), F.sum("count").alias("object_total"))
    joined = preps.join(bare, "root").join(objects, "root", "full")
    none = lambda name: F.array().cast(f"array<struct<{name}:string,count:bigint>>")
    return joined.select("root", F.coalesce("preps", none("prep")).alias("preps"), F.coalesce("governed", F.lit(0)).alias("governed"), F.coalesce("bare", F.lit(0)).alias("bare"), F.coalesce("objects", none("noun")).alias("objects"), F.coalesce("object_total", F.lit(0)).alias("object_total"))


def construction(tokens: DataFrame, occurrences: DataFrame, head: str, *, prep: str | None = None, present: bool = True, span: int = 3, object_definite: bool | None = None, context: int = 3) -> DataFrame:
    """Occurrences of a head lemma: its particle (mined frame, else a standalone one within the span), its object and their context.

    The object is the particle's own word where they are written as one, else the first nominal after it, else the next nominal of the span. ``prep`` asks for a particle, or with ``present``
    false for its absence; ``object_definite`` for the object's definiteness.
    """
    ahead = F.collect_list(F.struct("pos", "orig", "norm", "m")).over(_w().rowsBetween(1, span))
    side = lambda a, b: F.array_join(F.collect_list("orig").over(_w().rowsBetween(a, b)), " ")
    rows = tokens.select("pid", "grp", "ord", "pos", "orig", "m", ahead.alias("ahead"), side(-context, -1).alias("left"), side(1, context).alias("right")).where(F.col("m.lemma") == head)
    framed = occurrences.where(F.col("head") == head).select("pid", F.col("head_idx").alias("pos"), F.col("prep").alias("frame_prep"), "prep_idx")
    rows = rows.join(framed, ["pid", "pos"], "left")
    standalone = F.try_element_at(F.filter("ahead", lambda x: x["norm"].isin(*GOVERNORS)), F.lit(1))
    rows = rows.withColumn("particle", F.coalesce("frame_prep", standalone["norm"])).withColumn("particle_at", F.coalesce("prep_idx", standalone["pos"]))
    nominal = lambda x: x["m"]["pos"].isin(*NOUNS, "adj", "pron") & (F.col("particle_at").isNull() | (x["pos"] >= F.col("particle_at")))
    rows = rows.withColumn("object", F.try_element_at(F.filter("ahead", nominal), F.lit(1))).withColumn("definite", definite(F.col("object.orig"), F.col("object.m")))
    if prep is not None:
        has = F.coalesce(F.col("particle") == prep, F.lit(False))
        rows = rows.where(has if present else ~has)
    if object_definite is not None:
        rows = rows.where(F.col("definite") == object_definite)
    return rows.select("pid", "grp", "ord", "pos", "left", F.col("orig").alias("hit"), "right", "particle", F.col("object.orig").alias("object"), "definite")


def facets(tokens: DataFrame, occurrences: DataFrame, head: str) -> DataFrame:
    """What a head's occurrences offer to choose from: its prepositions, aspects and voices."""
    own = tokens.where(F.col("m.lemma") == head).agg(F.count("*").alias("total"), F.sort_array(F.collect_set("m.aspect")).alias("aspects"), F.sort_array(F.collect_set("m.voice")).alias("voices"))
    return own.join(F.broadcast(occurrences.where(F.col("head") == head).agg(F.sort_array(F.collect_set("prep")).alias("preps"))))


def of_root(frames_: DataFrame, nouns: DataFrame, root: str) -> DataFrame:
    """All expressions of a root: kind, text, count."""
    f = frames_.where(F.col("root") == root).select(F.lit("frame").alias("kind"), F.concat_ws(" ", "head", "prep").alias("text"), "count")
    c = nouns.where((F.col("verb_root") == root) | (F.col("noun_root") == root)).select(F.lit("collocation").alias("kind"), F.concat_ws(" ", "verb", "noun").alias("text"), "count")
    return f.unionByName(c)
