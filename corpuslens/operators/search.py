"""Forgiving term resolution, full-text search, phrases and the quotation locator."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import arabic


def resolve(alias: DataFrame, query: str, frequency: DataFrame, *, stems: bool = True, variants: list[str] | None = None, limit: int = 12) -> DataFrame:
    """key, tier, dist and df of what a typed term may mean, best first.

    ``alias`` has (alias, key). Tier 3: an alias, or a stem of it, is the query; 2: begins with it; 1: contains it (three
    letters at least). Only if there is none of these, tier 0: within an edit distance of 1, or of 2 beyond four letters.
    """
    asked = F.array(*[F.lit(v) for v in (variants or [query])])
    forms = F.concat(F.array("alias"), arabic.de_affix(F.col("alias"))) if stems else F.array("alias")
    any_ = lambda test: F.exists("forms", lambda f: F.exists(asked, lambda q: test(f, q)))
    tier = F.when(any_(lambda f, q: f == q), 3).when(any_(lambda f, q: f.startswith(q)), 2).when(any_(lambda f, q: (F.length(q) >= 3) & f.contains(q)), 1)
    most = 1 if len(query) <= 4 else 2
    near = lambda f, q: F.levenshtein(f, q, most)
    dist = F.array_min(F.filter(F.flatten(F.transform("forms", lambda f: F.transform(asked, lambda q: near(f, q)))), lambda d: d >= 0))
    rows = alias.select("alias", "key", forms.alias("forms")).select("key", tier.alias("tier"), dist.alias("d")).where("tier is not null or d is not null")
    best = rows.groupBy("key").agg(F.max("tier").alias("tier"), F.min("d").alias("d"))
    any_tier = best.agg(F.max("tier").alias("top"))
    chosen = best.join(F.broadcast(any_tier)).where(F.col("tier").isNotNull() | F.col("top").isNull())
    ranked = chosen.join(frequency, "key").select("key", F.coalesce("tier", F.lit(0)).alias("tier"), F.when(F.col("tier").isNull(), F.col("d")).otherwise(0).alias("dist"), "df")
    return ranked.orderBy(F.desc("tier"), "dist", F.desc("df"), "key").limit(limit)


def resolve_term(alias: DataFrame, query: str, frequency: DataFrame, *, variants: list[str] | None = None, alternatives: int = 8) -> DataFrame:
    """key, source, tier, dist, df and rank of what a typed term resolves to: rank 1 is the key to look up, then the alternatives.

    ``alias`` has (alias, tier, key) as from tokens.aliases; ``frequency`` (key, df) of the mode. First the key that the
    query's own norm or alias names (direct), then the forgiving candidates in the order of resolve: by the strong aliases,
    and by the fuzzy ones where those give none. Only a query in Latin letters that gives neither goes by its consonants.
    """
    asked = variants or [query]
    typed = alias.sparkSession.range(1).select(F.explode(F.array_distinct(F.flatten(F.array(*[F.concat(F.array(F.lit(v)), arabic.strong_keys(F.lit(v))) for v in asked])))).alias("typed"))
    strong = alias.where("tier = 'strong'").select("alias", "key")
    forms = [F.lit(v) for v in asked] + [arabic.norm(F.lit(v)) for v in asked]
    own = frequency.where(F.col("key").isin(*forms)).select("key", F.lit(0).alias("order"), "df")
    named = strong.join(F.broadcast(typed), F.col("alias") == F.col("typed")).select("key").distinct().join(frequency, "key").select("key", F.lit(1).alias("order"), "df")
    direct = own.unionByName(named).orderBy("order", F.desc("df"), "key").limit(1).select("key", F.lit("direct").alias("source"), F.lit(4).alias("tier"), F.lit(0).alias("dist"), "df", F.lit(0).alias("step"))
    normed = [n for n in (re.sub("[^ء-ي]", "", unicodedata.normalize("NFKC", v).translate(str.maketrans("ٱآأإةىؤئ", "اااا" + "هيوي"))) for v in asked) if n]
    found = lambda step, name, df: df.select("key", F.lit(name).alias("source"), "tier", F.col("dist").cast("int").alias("dist"), "df", F.lit(step).alias("step"))
    steps = direct
    if normed:
        steps = steps.unionByName(found(1, "alias", resolve(strong, normed[0], frequency, variants=normed)))
        steps = steps.unionByName(found(2, "fuzzy", resolve(alias.where("tier = 'fuzzy'").select("alias", "key"), normed[0], frequency, variants=normed)))
    if re.search("[A-Za-z]", query) and not re.search("[\u0600-\u06ff]", query):
        steps = steps.unionByName(found(3, "romanised", romanised(frequency, query, frequency)))
    least = steps.agg(F.min(F.when(F.col("step") > 0, F.col("step"))).alias("first"), F.min("step").alias("any"))
    kept = steps.join(F.broadcast(least)).where((F.col("step") == 0) | (F.col("step") == F.col("first")) & ((F.col("step") < 3) | (F.col("any") == 3)))
    one = kept.groupBy("key").agg(F.min(F.struct("step", (-F.col("tier")).alias("t"), "dist", (-F.col("df")).alias("d"), "source", "tier", "df")).alias("x"))
    # a handful of rows: the limits of resolve and romanised
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("x.step", "x.t", "x.dist", "x.d", "key"))
    return one.select("key", "x.source", "x.tier", "x.dist", "x.df", rank.alias("rank")).where(F.col("rank") <= alternatives + 1)


def romanised(alias: DataFrame, query: str, frequency: DataFrame, particles: tuple[str, ...] = (), limit: int = 8) -> DataFrame:
    """Keys whose consonant skeleton a romanised query has: tier 3 equal, 2 begins with it (three letters longer at most), 1 within an edit distance."""
    q = arabic.latin_skeleton(F.lit(query))
    skeletons = F.array_distinct(F.transform(F.concat(F.array("key"), arabic.de_affix(F.col("key"))), arabic.arabic_skeleton))
    rows = alias.select("key").distinct().select("key", F.explode(skeletons).alias("s"), q.alias("q")).where("length(s) >= 2 and length(q) >= 2")
    most = F.when(F.length("q") <= 4, 1).otherwise(2)
    d = F.levenshtein("s", "q")
    tier = F.when(F.col("s") == F.col("q"), 3).when(F.col("s").startswith(F.col("q")) & (F.length("s") - F.length("q") <= 3), 2).when(d <= most, 1)
    best = rows.select("key", tier.alias("tier"), F.when(tier == 1, d).otherwise(0).alias("dist")).where("tier is not null").groupBy("key").agg(F.max(F.struct("tier", (-F.col("dist")).alias("near"))).alias("b"))
    ranked = best.join(frequency, "key").select("key", F.col("b.tier").alias("tier"), (-F.col("b.near")).alias("dist"), F.col("key").isin(*particles).alias("particle") if particles else F.lit(False).alias("particle"), "df")
    return ranked.orderBy(F.desc("tier"), "dist", "particle", F.desc("df"), "key").limit(limit)


def content_index(tokens: DataFrame, arabic_words: bool = True) -> DataFrame:
    """(pid, grp, ord, pos, variants): what full-text search compares."""
    v = arabic.full_text_variants(F.col("orig")) if arabic_words else F.array("key")
    return tokens.select("pid", "grp", "ord", "pos", v.alias("variants"))


def full_text(index: DataFrame, query: list[list[str]], limit: int = 200, rare: int = 60) -> DataFrame:
    """pid, matched, run, ordered, score and positions of the passages that have the query's words, each given by its variants.

    Passages with all words; if there are none, of three words or more those with all but one; of two those with the rarer
    word, if at most ``rare`` passages have it. The score is 10,000 for each word of the longest run that begins the query,
    1,000 if all words come in order, and 10 for each word found.
    """
    n = len(query)
    which = F.array_compact(F.array(*[F.when(F.arrays_overlap("variants", F.array(*map(F.lit, v))), F.lit(i)) for i, v in enumerate(query)]))
    hits = index.select("pid", "grp", "ord", "pos", which.alias("which")).where(F.size("which") > 0)
    per = hits.groupBy("pid", "grp", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "which"))).alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_list("which")))).alias("matched"))
    has = lambda i: F.exists("hits", lambda h: F.array_contains(h["which"], F.lit(i)))
    df = per.agg(F.max("matched").alias("most"), *[F.sum(has(i).cast("long")).alias(f"df{i}") for i in range(n)])
    enough = F.col("matched") == n
    if n >= 3:
        enough = enough | ((F.col("most") == n - 1) & (F.col("matched") == n - 1))
    elif n == 2:
        rarer = F.when((F.col("df0") > 0) & ((F.col("df1") == 0) | (F.col("df0") <= F.col("df1"))), 0).otherwise(1)
        enough = enough | ((F.col("most") < n) & F.when(rarer == 0, has(0) & (F.col("df0") <= rare)).otherwise(has(1) & (F.col("df1") <= rare)))
    run = F.lit(0)
    at = lambda h, i: F.exists("hits", lambda x: (x["pos"] == h["pos"] + i) & F.array_contains(x["which"], F.lit(i)))
    for length in range(1, n + 1):
        run = F.when(F.exists("hits", _run(at, length)), length).otherwise(run)
    step = F.aggregate("hits", F.lit(0), lambda s, h: F.when(F.array_contains(h["which"], s), s + 1).otherwise(s))
    scored = per.join(F.broadcast(df)).where(enough).select("pid", "grp", "ord", "matched", run.alias("run"), (step == n).alias("ordered"), F.transform("hits", lambda h: h["pos"]).alias("positions"))
    score = F.col("run") * 10_000 + F.when(F.col("ordered"), 1000).otherwise(0) + F.col("matched") * 10
    return scored.withColumn("score", score).orderBy(F.desc("score"), "grp", "ord").limit(limit)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _run(at, length: int):
    return lambda h: _all(at(h, i) for i in range(length))


def phrase(tokens: DataFrame, words: list[str], proclitics: bool = False) -> DataFrame:
    """pid and start of each place where the keys follow one another; with ``proclitics`` the first may carry up to two letters before it."""
    w = Window.partitionBy("pid").orderBy("pos")
    first = F.col("key") == words[0]
    if proclitics:
        first = first | (F.col("key").rlike(f"^[{arabic.PROCLITICS}]{{1,2}}") & F.col("key").endswith(words[0]) & (F.length("key") - len(words[0]) <= 2))
    rest = [F.lead("key", i).over(w) == x for i, x in enumerate(words) if i]
    return tokens.select("pid", "grp", "ord", F.col("pos").alias("start"), (first & _all(rest)).alias("ok")).where("ok").drop("ok")


def resolve_phrase(tokens: DataFrame, forms: list[list[str]]) -> DataFrame:
    """Passages that have a form of each word (forms by word), and whether they follow one another somewhere."""
    pos = lambda i: F.collect_set(F.when(F.col("key").isin(*forms[i]), F.col("pos")))
    per = tokens.where(F.col("key").isin(*sorted({f for fs in forms for f in fs}))).groupBy("pid", "grp", "ord").agg(*[pos(i).alias(f"p{i}") for i in range(len(forms))])
    found = per.where(_all(F.size(f"p{i}") > 0 for i in range(len(forms))))
    adjacent = F.exists("p0", lambda x: _all(F.array_contains(f"p{i}", x + i) for i in range(1, len(forms))))
    return found.select("pid", "grp", "ord", adjacent.alias("adjacent"))


def locate_across(tokens: DataFrame, query: list[list[str]]) -> DataFrame:
    """grp, first passage and position of a quotation given by alternative keys for each word, which may run over into the next passages of a group.

    Tokens have ``quote_keys``. A word of the text may stand for two words of the query written together: it then has the
    key of both. Windows look ahead by the query's length only.
    """
    n = len(query)
    w = Window.partitionBy("grp").orderBy("ord", "pos")
    ahead = F.collect_list("quote_keys").over(w.rowsBetween(0, n - 1))
    alternatives = F.array(*[F.array(*map(F.lit, q)) for q in query])
    fused = F.array(*[F.array(*[F.lit(a + b) for a in query[i] for b in (query[i + 1] if i + 1 < n else [])]).cast("array<string>") for i in range(n)])

    def step(at: Column, keys: Column) -> Column:
        i = at + 1
        one = F.coalesce(F.arrays_overlap(keys, F.element_at(alternatives, F.least(i, F.lit(n)))), F.lit(False))
        two = F.coalesce(F.arrays_overlap(keys, F.element_at(fused, F.least(i, F.lit(n)))), F.lit(False))
        return F.when((at < 0) | (at >= n), at).when(one, at + 1).when(two, at + 2).otherwise(-1)

    found = tokens.select("grp", "ord", "pid", "pos", ahead.alias("ahead")).withColumn("got", F.aggregate("ahead", F.lit(0), step))
    return found.where(F.col("got") == n).select("grp", "ord", "pid", "pos")


def group_index(groups: DataFrame) -> DataFrame:
    """(alias, grp) of groups (grp, name, latin): number, name and Latin name, each folded; an alias of two groups is void."""
    latin = F.regexp_replace(F.lower("latin"), "[^a-z]", "")
    rows = groups.select("grp", F.explode(F.array(F.col("grp").cast("string"), arabic.norm(F.col("name")), latin, F.regexp_replace(latin, "^a[lnrstzd]", ""))).alias("alias")).where("alias != ''").distinct()
    return rows.groupBy("alias").agg(F.min("grp").alias("grp"), F.count("*").alias("n")).where("n = 1").drop("n")


def verse_key(text: Column) -> Column:
    """grp and ord of a reference such as 2:255, 2/255 or 2,255; null for other text."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d+)\s*[:/,]\s*(\d+)\s*$", i)
    return F.when(part(1) != "", F.struct(part(1).cast("long").alias("grp"), part(2).cast("long").alias("ord")))
