"""The token table, which all analyses start from, and what is derived from it directly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import arabic

from .ordered import numbered

#: Between the words of the Latin-script tables; words are lower-cased and have two letters at least.
NO_WORD = "[^a-zäöüßéèêàâçñáíóúîôûëï]+"
#: Very frequent words of the English tables: the default stop set of the queries.
STOP = ("the", "of", "and", "to", "is", "in", "that", "it", "for", "with", "as", "was", "on", "be", "at", "by", "this", "are", "an", "or")

# The Arabic stop words, by norm: particles, and frequent content words that may be let through.
ARABIC_PARTICLES = tuple("في من على الى عن ان لا ما هو لم قد بل ثم او كل هم هن هي نحن الذي الذين التي ذلك هذا هذه تلك الا اذا اذ حتى لن لو مع بين عند فيه فيها منه منها عليه عليها اليه اليها به بها له لها لهم لكم لنا بكم منكم عليكم فيهم منهم عليهم وما فما بما مما عما كما لما فلا ولا يا ايها انه انها انا لك ذا اولئك هولاء كيف اين متى هل انما ذلكم".split())
ARABIC_CONTENT = tuple("الله رب ربك ربكم ربه ربهم قل قال قالوا كان كانوا كانت".split())


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: F.length(w) >= 2)


def stand_in_lemma(key: Column) -> Column:
    """A word without a short ending: a stand-in for a lemma where there are no annotations, not linguistics."""
    bare = F.regexp_replace(key, "(ing|ed|er|es|s|e)$", "")
    return F.when(F.length(bare) >= 2, bare).otherwise(key)


def stand_in_root(key: Column) -> Column:
    """The first three consonants of a word, or null if it has none: a stand-in for a root."""
    return F.nullif(F.substring(F.regexp_replace(key, "[aeiouyäöüéèêàâáíóúîôûëï]", ""), 1, 3), F.lit(""))


def tokens(passages: DataFrame) -> DataFrame:
    """A row for each word of Latin-script passages: pid, grp, ord, pos, orig, key, lemma, root. Positions count kept words. No shuffle."""
    rows = passages.select("pid", "grp", "ord", F.posexplode(words_of(F.col("text"))).alias("pos", "key"))
    return rows.select("pid", "grp", "ord", "pos", F.col("key").alias("orig"), "key", stand_in_lemma(F.col("key")).alias("lemma"), stand_in_root(F.col("key")).alias("root"))


def word_counts(passages: DataFrame) -> DataFrame:
    """pid, key and n: how often each passage has each of its words. A passage is one row, so it is counted within it, without a shuffle."""
    s = F.array_sort(words_of(F.col("text")))
    last = lambda i: (i == F.size("s")) | (F.get("s", i - 1) != F.get("s", i))
    ends = passages.select("pid", s.alias("s")).where(F.size("s") > 0).withColumn("ends", F.filter(F.sequence(F.lit(1), F.size("s")), last))
    before = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    counted = F.zip_with("ends", before, lambda b, a: F.struct(F.get("s", b - 1).alias("key"), (b - a).alias("n")))
    return ends.select("pid", F.explode(counted).alias("c")).select("pid", "c.key", "c.n")


def arabic_tokens(passages: DataFrame, strict: bool = False) -> DataFrame:
    """The same for Arabic passages, without lemma and root: words by white space whose norm has two letters at least."""
    pairs = F.transform(F.split(F.trim("text"), r"\s+"), lambda w: F.struct(w.alias("orig"), arabic.norm(w).alias("norm")))
    rows = passages.select("pid", "grp", "ord", F.posexplode(F.filter(pairs, lambda x: F.length(x["norm"]) >= 2)).alias("pos", "w"))
    return rows.select("pid", "grp", "ord", "pos", "w.orig", "w.norm", (arabic.norm_strict(F.col("w.orig")) if strict else F.col("w.norm")).alias("key"))


def mode_key(mode: str) -> Column:
    """The grouping key of a token: the word, its lemma or its root, and the word itself where it has none."""
    return {"exact": F.col("key"), "lemma": F.coalesce("lemma", "key"), "root": F.coalesce("root", "key")}[mode]


def annotate(tokens_: DataFrame, voted_roots: DataFrame, voted_lemmas: DataFrame) -> DataFrame:
    """Roots and lemmas voted for a norm, where the token has none of its own. The voted maps are small dimensions, which Spark broadcasts below its threshold."""
    joined = tokens_.join(voted_roots.select("norm", F.col("root").alias("voted_root")), "norm", "left").join(voted_lemmas.select("norm", F.col("lemma").alias("voted_lemma")), "norm", "left")
    own = lambda c: F.col(c) if c in tokens_.columns else F.lit(None).cast("string")
    return joined.select(*[c for c in tokens_.columns if c not in ("root", "lemma")], F.coalesce(own("root"), "voted_root").alias("root"), F.coalesce(own("lemma"), "voted_lemma").alias("lemma"))


def attach_morphology(tokens_: DataFrame, morph: DataFrame) -> DataFrame:
    """Adds the struct m of (pid, pos, m) to the tokens; a passage whose counts of tokens and analyses differ gets none."""
    n_tokens = tokens_.groupBy("pid").agg(F.count("*").alias("n_tokens"))
    n_morph = morph.groupBy("pid").agg(F.count("*").alias("n_morph"))
    aligned = n_tokens.join(n_morph, "pid").where("n_tokens = n_morph").select("pid")
    return tokens_.join(morph.join(aligned, "pid", "left_semi").select("pid", "pos", "m"), ["pid", "pos"], "left")


def align_words(tokens_: DataFrame, corpus_words: DataFrame) -> DataFrame:
    """(pid, pos, word) of tokens and corpus words (pid, word, form): by place where a passage has as many of both, else by the first equal form."""
    count = lambda df, n: df.groupBy("pid").agg(F.count("*").alias(n))
    even = count(tokens_, "a").join(count(corpus_words, "b"), "pid", "left").select("pid", (F.col("a") == F.coalesce("b", F.lit(0))).alias("even"))
    ranked = corpus_words.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy("word")) - 1)
    first = corpus_words.groupBy("pid", F.col("form").alias("norm")).agg(F.min("word").alias("by_form"))
    return tokens_.join(even, "pid").join(ranked.select("pid", F.col("place").alias("pos"), F.col("word").alias("by_place")), ["pid", "pos"], "left").join(first, ["pid", "norm"], "left").select(
        "pid", "pos", F.when(F.col("even"), F.col("by_place")).otherwise(F.col("by_form")).alias("word"))


def postings(tokens_: DataFrame, mode: str = "exact") -> DataFrame:
    """Distinct (key, pid, grp, ord): the inverted index of a mode."""
    return tokens_.select(mode_key(mode).alias("key"), "pid", "grp", "ord").distinct()


def document_frequency(tokens_: DataFrame, mode: str = "exact") -> DataFrame:
    return postings(tokens_, mode).groupBy("key").agg(F.count("*").alias("df"))


def reading_order(passages: DataFrame) -> DataFrame:
    """Passages with the number of their place (nth) in the order of groups and of passages in them, counted in ranges."""
    return numbered(passages.select("pid", "grp", "ord"), [F.col("grp"), F.col("ord")], "nth")


def vote(pairs: DataFrame, key: str, value: str, at: list[str]) -> DataFrame:
    """The commonest value of each key; of equally common ones that which comes first in order of ``at``, then the least."""
    counted = pairs.groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*at)).alias("first"))
    return counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", value)).alias("best")).select(key, F.col(f"best.{value}").alias(value), (-F.col("best.m")).alias("votes"))


def aliases(forms: DataFrame) -> DataFrame:
    """(alias, tier, key): the forgiving keys of (orig, key, first); the first key in reading order owns an alias."""
    rows = forms.select("key", "first", F.explode(F.concat(
        F.transform(arabic.strong_keys(F.col("orig")), lambda k: F.struct(k.alias("alias"), F.lit("strong").alias("tier"))),
        F.transform(arabic.fuzzy_keys(F.col("orig")), lambda k: F.struct(k.alias("alias"), F.lit("fuzzy").alias("tier"))))).alias("a"))
    return rows.groupBy("a.alias", "a.tier").agg(F.min_by("key", F.struct("first", "key")).alias("key"))


def without_stops(tokens_: DataFrame, stops: tuple[str, ...], mode: str = "exact") -> DataFrame:
    """Drops tokens of which the word or the key is a stop word."""
    return tokens_.where(~F.col("key").isin(*stops) & ~mode_key(mode).isin(*stops)) if stops else tokens_


def stop_set(base: tuple[str, ...], extra: tuple[str, ...] = (), disabled: tuple[str, ...] = ()) -> tuple[str, ...]:
    return tuple(sorted((set(base) | set(extra)) - set(disabled)))


def in_range(passages: DataFrame, group, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Passages of a group, between two places of either order."""
    found = passages.where(F.col("grp") == group)
    ends = [x for x in (lo, hi) if x is not None]
    return found.where(F.col("ord").between(min(ends), max(ends))) if ends else found


def hits(tokens_: DataFrame, term: str, mode: str = "exact") -> DataFrame:
    """pid, n_tokens and the positions of the term in each passage that has it."""
    return tokens_.groupBy("pid", "grp", "ord").agg(F.count("*").alias("n_tokens"), F.array_sort(F.collect_list(F.when(mode_key(mode) == term, F.col("pos")))).alias("positions")).where(F.size("positions") > 0)


#: Fields of an analysis that a passage shows; those that say nothing are left out.
SHOWN = ("pos", "vf", "aspect", "voice", "mood", "person", "gender", "number", "gcase")


def passage_view(passages: DataFrame, tokens_: DataFrame, term: str | None = None, mode: str = "exact") -> DataFrame:
    """pid, grp, ord, text, the places of a term (matches) and the words of each passage, with their keys and analyses as JSON.

    Words are gathered by passage, so a row is as large as a passage. Passages without words have none.
    """
    fields = {f.name for f in tokens_.schema["m"].dataType.fields} if "m" in tokens_.columns and hasattr(tokens_.schema["m"].dataType, "fields") else set()
    said = [F.when((F.col(f"m.{f}").cast("string") != "") & (F.col(f"m.{f}").cast("string") != "0"), F.col(f"m.{f}")).alias(f) for f in SHOWN if f in fields]
    morphology = F.when(F.col("m").isNotNull(), F.to_json(F.struct(*said))) if said else F.lit(None).cast("string")
    normalized = F.col("norm") if "norm" in tokens_.columns else F.col("key")
    word = F.struct(F.col("pos").alias("index"), F.col("orig").alias("form"), normalized.alias("normalized"), "root", "lemma", morphology.alias("morphology"))
    matches = F.array_sort(F.collect_list(F.when(mode_key(mode) == term, F.col("pos")))) if term is not None else F.array().cast("array<int>")
    words = tokens_.groupBy("pid").agg(F.array_sort(F.collect_list(word)).alias("words"), matches.alias("matches"))
    return passages.join(words, "pid", "left").select("pid", "grp", "ord", "text", "words", "matches")
