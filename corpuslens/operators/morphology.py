"""Analyses of annotated tokens: words from segments, roles, register shifts, rhetoric, antithesis. Tokens have the struct m."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import arabic

# Forms that the role and rhetoric rules look for, by norm.
VOCATIVES = ("يا", "ايا", "ايها", "ايتها")
CONJUNCTIONS = ("و", "ف", "ثم", "او", "بل", "ام")
PREPOSITIONS = ("من", "الى", "عن", "على", "في", "حتى", "منذ", "رب", "خلا", "عدا", "حاشا", "مذ", "كي", "واو")
CONDITIONALS = ("اذا", "لو", "لولا", "لوما", "كلما", "لئن", "اذما", "اينما", "حيثما", "مهما", "متى", "انى")
OATHS = ("تالله", "لعمرك")
NEGATIONS, ADVERSATIVES = ("لا", "ما", "لم", "لن", "ليس", "ليست", "غير"), ("بل", "لكن", "ولكن")
#: The prepositions that govern a word, by norm; ب, ل and ك are written as one with it.
GOVERNORS = ("ب", "ل", "ك", "من", "في", "علي", "الي", "عن", "حتي")
NOMINAL = ("noun", "pn", "adj", "actpcpl", "passpcpl", "pron")


def words_from_segments(segments: DataFrame) -> DataFrame:
    """pid, word, form and the analysis m of its stem: the first segment with a root, else the first that is no affix, else the first.

    ``prep`` is the norm of the lemma of its first segment that is a governing preposition, ``det`` whether it has an article.
    """
    tagged = lambda t: F.array_contains(F.split(F.coalesce("features", F.lit("")), r"\|"), t)
    rows = segments.select("pid", "word", "seg", "form", arabic.parse_tags(F.col("features"), F.col("pos_class")).alias("m"), tagged("P").alias("p"), tagged("DET").alias("det"))
    rows = rows.withColumn("prep", F.when(F.col("p") & arabic.norm(F.col("m.lemma")).isin(*GOVERNORS), arabic.norm(F.col("m.lemma"))))
    rank = F.when(F.col("m.root").isNotNull(), 0).when(~F.col("m.pref") & ~F.col("m.suff"), 1).otherwise(2)
    return rows.groupBy("pid", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.coalesce("form", F.lit("")).alias("form")))), lambda x: x["form"]), "").alias("form"), F.min_by("m", F.struct(rank, "seg")).alias("m"), F.min_by("prep", F.when(F.col("prep").isNotNull(), F.col("seg"))).alias("prep"), F.max("det").alias("det"))


def roles(tokens: DataFrame) -> DataFrame:
    """Adds role and confidence: a proxy of the syntactic role, from case, part of speech and the words before."""
    w = Window.partitionBy("pid").orderBy("pos")
    before, pos_before, case, pos = F.coalesce(F.lag("norm").over(w), F.lit("")), F.coalesce(F.lag("m.pos").over(w), F.lit("")), F.col("m.gcase"), F.col("m.pos")
    verb_near = F.coalesce(F.max((pos == "verb").cast("int")).over(w.rowsBetween(-2, -1)), F.lit(0)) == 1
    conjoined = before.isin(*CONJUNCTIONS) | ((pos_before == "particle") & before.rlike("^[وف]"))
    proclitic = F.col("norm").rlike("^[بلك].")
    as_ = lambda role, sure: F.struct(F.lit(role).alias("role"), F.lit(sure).alias("confidence"))
    rule = (
        F.when(F.col("m").isNull(), as_("unknown", "none"))
        .when(before.isin(*VOCATIVES), as_("vocative", "high"))
        .when(conjoined & pos.isin(*NOMINAL), F.struct(F.lit("conjoined").alias("role"), F.when(case.isNotNull(), "high").otherwise("low").alias("confidence")))
        .when((case == "gen") & (pos_before == "particle") & before.isin(*PREPOSITIONS), as_("prepositional", "high"))
        .when((case == "gen") & proclitic, as_("prepositional", "low"))
        .when((case == "gen") & pos_before.isin(*NOMINAL), as_("annexed", "high"))
        .when(case == "gen", as_("prepositional", "low"))
        .when((case == "acc") & verb_near, as_("object", "high"))
        .when(case == "acc", as_("accusative", "low"))
        .when(case == "nom", as_("nominative", "high"))
        .when(pos == "verb", as_("verb", "high"))
        .when(pos == "particle", as_("particle", "high"))
        .otherwise(as_("other", "low"))
    )
    return tokens.withColumn("r", rule).select(*tokens.columns, "r.role", "r.confidence")


def role_breakdown(with_roles: DataFrame, examples: int = 6) -> DataFrame:
    counts = with_roles.groupBy("role").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    first = with_roles.withColumn("n", F.row_number().over(Window.partitionBy("role").orderBy("grp", "ord", "pos"))).where(F.col("n") <= examples).groupBy("role").agg(F.array_sort(F.collect_list(F.struct("grp", "ord", "pos", "pid"))).alias("examples"))
    return counts.join(F.broadcast(total)).join(first, "role").select("role", "count", (F.col("count") / F.col("total")).alias("share"), "examples")


def _dominant(rows: DataFrame, field: str, last_wins: bool) -> DataFrame:
    """The commonest value of a field by passage; of equal ones the one that comes last, or the first."""
    at = F.max("pos") if last_wins else -F.min("pos")
    counted = rows.where(F.col(field).isNotNull()).groupBy("pid", F.col(field).alias("value")).agg(F.struct(F.count("*").alias("n"), at.alias("at")).alias("rank"))
    return counted.groupBy("pid").agg(F.max_by("value", "rank").alias(field))


def _shifts(contour: DataFrame, fields: list[str]) -> DataFrame:
    """Changes from the last passage of the group that has a person: of the person, or else of the finer fields."""
    w = Window.partitionBy("grp").orderBy("ord")
    rows = contour.where("person is not null")
    seen = rows.select("grp", "ord", *["person", *fields], *[F.lag(c).over(w).alias(f"old_{c}") for c in ("ord", "person", *fields)]).where("old_ord is not null")
    same = F.col("person") == F.col("old_person")
    kinds = [F.when(~same, F.struct(F.lit("person").alias("type"), F.col("old_person").cast("string").alias("from"), F.col("person").cast("string").alias("to")))]
    kinds += [F.when(same & (F.col(c) != F.col(f"old_{c}")), F.struct(F.lit(c).alias("type"), F.col(f"old_{c}").alias("from"), F.col(c).alias("to"))) for c in fields]
    return seen.select("grp", F.col("old_ord").alias("a"), F.col("ord").alias("b"), F.explode(F.array_compact(F.array(*kinds))).alias("s")).select("grp", "a", "b", "s.type", "s.from", "s.to")


def register_shifts(tokens: DataFrame) -> DataFrame:
    """Shifts between passages by words: the dominant person of verbs and pronouns (the last of equal ones), with the number and gender of its last word, and the dominant aspect and voice of the verbs."""
    deixis = tokens.where((F.col("m.person") > 0) & F.col("m.pos").isin("verb", "pron")).select("pid", "pos", "m.person", "m.number", "m.gender", F.when(F.col("m.pos") == "verb", F.col("m.aspect")).alias("aspect"), F.when(F.col("m.pos") == "verb", F.col("m.voice")).alias("voice"))
    person = _dominant(deixis, "person", True)
    decider = deixis.join(person, ["pid", "person"]).groupBy("pid", "person").agg(F.max_by("number", "pos").alias("number"), F.max_by("gender", "pos").alias("gender"))
    passages = tokens.select("pid", "grp", "ord").distinct()
    contour = passages.join(decider, "pid", "left").join(_dominant(deixis, "aspect", True), "pid", "left").join(_dominant(deixis, "voice", True), "pid", "left")
    return _shifts(contour, ["number", "gender", "aspect", "voice"])


def segment_shifts(segments: DataFrame) -> DataFrame:
    """Shifts by segments (pid, grp, ord, pos, m): a passage is in the second person if any segment is, else in the first, else in the third; first values win ties."""
    rows = segments.select("pid", "grp", "ord", "pos", "m.person", "m.number", "m.aspect", "m.voice")
    has = lambda p: F.max((F.col("person") == p).cast("int"))
    person = rows.groupBy("pid", "grp", "ord").agg(F.when(has(2) == 1, 2).when(has(1) == 1, 1).otherwise(3).alias("person"))
    own = rows.join(person.select("pid", F.col("person").alias("p")), "pid")
    contour = person.join(_dominant(own.where("person = p"), "number", False), "pid", "left").join(_dominant(rows, "aspect", False), "pid", "left").join(_dominant(rows.where("aspect is not null"), "voice", False), "pid", "left")
    return _shifts(contour, ["number", "aspect", "voice"])


def rhetoric(tokens: DataFrame) -> DataFrame:
    """The first oath and the first conditional of each passage that has one: pid, kind, marker. An opening wa-al- in a group's first passage is an oath before all others."""
    opening = (F.col("ord") == 1) & (F.col("pos") == 0) & F.col("norm").startswith("وال") & (F.length("norm") >= 4)
    sworn = (F.col("m.pos") == "verb") & ((F.col("m.root") == "حلف") | ((F.col("m.root") == "قسم") & F.col("m.vf").isin(3, 4, 6)))
    oath = F.coalesce(opening | F.col("norm").isin(*OATHS) | sworn, F.lit(False))
    kinds = F.array_compact(F.array(F.when(oath, F.lit("oath")), F.when(F.col("norm").isin(*CONDITIONALS), F.lit("conditional"))))
    return tokens.select("pid", "grp", "ord", "pos", "orig", F.explode(kinds).alias("kind")).groupBy("pid", "grp", "ord", "kind").agg(F.min_by("orig", "pos").alias("marker"))


def antithesis_frames(tokens: DataFrame, negations: tuple[str, ...] = NEGATIONS, adversatives: tuple[str, ...] = ADVERSATIVES, most: int = 4) -> DataFrame:
    """Pairs of roots that a negation and an adversative set against each other: a, b, frames (units) and passages (where units begin).

    A unit is a passage, or a passage and the next of its group. Its first adversative, with a negation before it, parts it;
    units with no root or more than ``most`` on a side are left out. Roots at the same place on either side are paired, and
    the last before with the first after; a pair counts once in a unit.
    """
    per = tokens.groupBy("grp", "pid", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "root"))).alias("ws"))
    more = F.lead("ws").over(Window.partitionBy("grp").orderBy("ord"))
    units = per.withColumn("more", more).select("pid", F.explode(F.array_compact(F.array("ws", F.concat("ws", "more")))).alias("u"))
    is_in = lambda x, words: x["key"].isin(*words)
    cut = F.array_position(F.transform("u", lambda x: is_in(x, adversatives)), True)
    roots = lambda c: F.transform(F.filter(c, lambda x: x["root"].isNotNull()), lambda x: x["root"])
    parted = units.withColumn("cut", cut.cast("int")).where("cut > 1").select("pid", F.slice("u", F.lit(1), F.greatest(F.lit(0), F.col("cut") - 1)).alias("l"), roots(F.slice("u", F.greatest(F.lit(1), F.col("cut") + 1), F.size("u"))).alias("r"))
    sides = parted.where(F.exists("l", lambda x: is_in(x, negations))).select("pid", roots("l").alias("l"), "r").where(F.size("l").between(1, most) & F.size("r").between(1, most))
    both = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    at = F.transform(F.sequence(F.lit(1), F.least(F.size("l"), F.size("r"))), lambda i: both(F.get("l", i - 1), F.get("r", i - 1)))
    pairs = F.array_distinct(F.concat(at, F.array(both(F.element_at("l", -1), F.element_at("r", 1)))))
    return sides.select("pid", F.inline(pairs)).where("a != b").groupBy("a", "b").agg(F.count("*").alias("frames"), F.countDistinct("pid").alias("passages"))


def pair_evidence(tokens: DataFrame, a: str, b: str, near: int = 3) -> DataFrame:
    """Passages that show a pair of roots, and the level of all of them.

    Level 1 are those with both (the first 12); where there is none, level 2 those with one within ``near`` passages of the
    other in its group (the first 8 of each root, 12 in all); where there is none either, level 3 the first 4 of each root.
    If the tokens lack one of the roots there is no evidence.
    """
    rows = tokens.where(F.col("root").isin(a, b)).select("root", "pid", "grp", "ord").distinct()
    w = Window.partitionBy("grp").orderBy("ord").rangeBetween(-near, near)
    with_other = F.max(F.when(F.col("root") == a, 1).otherwise(0)).over(w) + F.max(F.when(F.col("root") == b, 1).otherwise(0)).over(w) == 2
    both = F.count("*").over(Window.partitionBy("pid")) == 2
    levels = rows.withColumn("level", F.when(both, 1).when(with_other, 2).otherwise(3))
    found = levels.agg(F.min("level").alias("best"), F.countDistinct("root").alias("roots"))
    chosen = levels.join(F.broadcast(found)).where((F.col("roots") == 2) & (F.col("level") <= F.col("best")))
    n = F.row_number().over(Window.partitionBy("root").orderBy("grp", "ord"))
    limit = F.when(F.col("best") == 1, 12).when(F.col("best") == 2, 8).otherwise(4)
    return chosen.withColumn("n", n).where(F.col("n") <= limit).select("pid", "grp", "ord", F.col("best").alias("level")).distinct().orderBy("grp", "ord").limit(12)


def relations(curated: DataFrame, frames: DataFrame) -> DataFrame:
    """Curated pairs (a, b, cat) with their frames, and framed pairs that aren't curated as candidates; a before b."""
    c = curated.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cat").distinct()
    known = c.join(frames, ["a", "b"], "left").select("a", "b", "cat", F.coalesce("frames", F.lit(0)).alias("frames"), F.lit("opposite").alias("polarity"))
    found = frames.join(c, ["a", "b"], "left_anti").select("a", "b", F.lit(None).cast("string").alias("cat"), "frames", F.lit("candidate").alias("polarity"))
    return known.unionByName(found)


def relations_of(all_: DataFrame, root: str) -> DataFrame:
    """A root's relations: curated opposites first, then by frames."""
    own = all_.where((F.col("a") == root) | (F.col("b") == root)).withColumn("other", F.when(F.col("a") == root, F.col("b")).otherwise(F.col("a")))
    return own.orderBy((F.col("polarity") != "opposite"), F.desc("frames"), "other").select("other", "polarity", "cat", "frames")


def definite(word: Column, m: Column) -> Column:
    """Whether a word is definite: a proper noun, a pronoun, or with an article behind two letters of proclitics at most; false for any other word, null for none."""
    bare = F.regexp_replace(arabic.norm(word), "^[وفبكلس]{0,2}", "")
    return F.when(word.isNotNull(), F.coalesce(m["pos"].isin("pn", "pron"), F.lit(False)) | bare.startswith("ال"))
