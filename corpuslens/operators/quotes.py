"""Where the quotations of a table stand in a running text.

A group's passages are one text: a quotation may run over their borders, not over those of groups. Words agree if they
share a key. Where a word of the text doesn't agree with the next word of the quotation, it may stand for two of them that
are written together. A quotation is looked for at its rarest pair of neighbouring words (or where these two are one word
of the text); only there is the text fetched, in blocks, and compared from the beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.stored import materialise

from .ordered import running_sum

#: Words of a block of text, and rows of a few words or numbers that are sent to all tasks at most.
BLOCK, MOST_SENT = 256, 1_000_000


def _sent(rows: DataFrame, name: str) -> DataFrame:
    """The stored rows, to be sent to all tasks if they are few: what they meet, the whole text, isn't shuffled then."""
    stored = materialise(rows, name, True)
    return F.broadcast(stored) if stored.count() <= MOST_SENT else stored


def _none() -> Column:
    return F.array().cast("array<string>")


def quotations(quotes: DataFrame, words: Column, keys: Callable[[Column], Column]) -> DataFrame:
    """(qid, words, joined) of quotes (qid and what ``words`` needs): the keys of each word, and of each with the next written together."""
    raw = quotes.select("qid", words.alias("w")).where(F.size("w") > 0)
    pairs = F.transform(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b")), lambda x: F.when(x["b"].isNotNull(), keys(F.concat(x["a"], x["b"]))).otherwise(_none()))
    return raw.select("qid", F.transform("w", lambda w: keys(w)).alias("words"), pairs.alias("joined"))


def running_text(passages: DataFrame, words: Column) -> DataFrame:
    """(grp, ord, pid, words, first): the keys of a passage's words and the number of words before them in the group; passages without words are left out."""
    rows = passages.select("grp", "ord", "pid", words.alias("words")).where(F.size("words") > 0).withColumn("n", F.size("words"))
    return materialise(running_sum(rows, [F.col("ord"), F.col("pid")], "n", "first", within="grp").drop("n"), "running-text")


def _pairs(text: DataFrame) -> DataFrame:
    """(a, b, grp, at): neighbouring keys, and the number in the group of the word of the first one; b is empty for a word by itself."""
    inside = text.select("grp", F.posexplode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.size("words")).alias("b"))).alias("i", "w"), "first")
    inside = inside.select("grp", (F.col("first") + F.col("i")).alias("at"), "w.a", F.coalesce("w.b", F.array()).alias("b"))
    # over a border: the passage that begins where another one ends
    ends = text.select("grp", (F.col("first") + F.size("words")).alias("next"), F.element_at("words", -1).alias("a"))
    begins = text.select(F.col("grp").alias("of"), F.col("first").alias("next"), F.element_at("words", 1).alias("b"))
    over = ends.join(begins, (F.col("grp").eqNullSafe(F.col("of"))) & (ends["next"] == begins["next"])).select("grp", (ends["next"] - 1).alias("at"), "a", "b")
    single = text.select("grp", F.posexplode("words").alias("i", "a"), "first").select("grp", (F.col("first") + F.col("i")).alias("at"), "a", F.array(F.lit("")).alias("b"))
    each = inside.where(F.size("b") > 0).unionByName(over).unionByName(single)
    return each.select("grp", "at", F.explode("a").alias("a"), "b").select("grp", "at", "a", F.explode("b").alias("b"))


def _seeds(asked: DataFrame) -> DataFrame:
    """(qid, n, j, a, b): what a match of the quotation has where its words j and j + 1 meet; of a quotation of one word, that word."""
    one = F.transform(F.element_at("words", 1), lambda k: F.struct(k.alias("a"), F.lit("").alias("b")))

    def at(j: Column) -> Column:
        left = F.concat(F.get("words", j), F.coalesce(F.get("joined", j - 1), _none()))
        right = F.concat(F.get("words", j + 1), F.coalesce(F.get("joined", j + 1), _none()))
        both = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(a.alias("a"), b.alias("b")))))
        return F.concat(both, F.transform(F.get("joined", j), lambda k: F.struct(k.alias("a"), F.lit("").alias("b"))))

    n = F.size("words")
    many = asked.where(n > 1).select("qid", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 2)).alias("j"), "words", "joined").select("qid", "n", "j", F.explode(F.array_distinct(at(F.col("j")))).alias("s"))
    few = asked.where(n == 1).select("qid", n.alias("n"), F.lit(0).alias("j"), F.explode(F.array_distinct(one)).alias("s"))
    return many.unionByName(few).select("qid", "n", "j", "s.a", "s.b")


def _covered(words: str, quote: str, joined: str) -> Column:
    """How many words of the text the quotation covers from the first on, or null where it breaks off."""
    state = F.struct(F.lit(0).alias("j"), F.lit(0).alias("n"))

    def step(s: Column, keys: Column) -> Column:
        j = s["j"]
        one, two = F.arrays_overlap(keys, F.get(quote, j)), F.arrays_overlap(keys, F.get(joined, j))
        on = lambda k: F.struct((j + k).alias("j"), (s["n"] + 1).alias("n"))
        return F.when((j < 0) | (j >= F.size(quote)), s).when(one, on(1)).when(two, on(2)).otherwise(F.struct(F.lit(-1).alias("j"), s["n"].alias("n")))

    end = F.aggregate(words, state, step)
    return F.when(end["j"] == F.size(quote), end["n"])


def locate_quotations(text: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, grp, place, pid, ord, at, count and words: for each place of a quotation, what it covers of each passage.

    ``text`` is a running text, ``asked`` has quotations. place: the number of the place's first word in its group; at: the
    first covered word of the passage; count: how many it covers there; words: all that the passage has.
    """
    seeds = materialise(_seeds(asked), "seeds", True)
    pairs = _pairs(text)
    wanted = _sent(seeds.select("a", "b").distinct(), "wanted")
    frequency = materialise(pairs.join(wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("df")), "frequency", True)
    sums = seeds.join(frequency, ["a", "b"], "left").groupBy("qid", "j").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"))
    rarest = sums.groupBy("qid").agg(F.min(F.struct("df", "j")).alias("r")).where("r.df > 0").select("qid", F.col("r.j").alias("j"))
    chosen = _sent(seeds.join(rarest, ["qid", "j"]), "chosen")
    # how many words before the seed may be written together with their next: those for which the text has such a word
    joined = _sent(asked.select(F.explode(F.flatten("joined")).alias("key")).distinct(), "joined")
    vocabulary = text.select(F.explode(F.flatten("words")).alias("key")).join(joined, "key", "left_semi").distinct()
    fused = asked.join(rarest, "qid").select("qid", "j", F.posexplode("joined").alias("i", "ks")).where("i < j").select("qid", "i", F.explode("ks").alias("key")).join(vocabulary, "key").groupBy("qid").agg(F.countDistinct("i").alias("most"))
    met = pairs.join(chosen, ["a", "b"]).join(fused, "qid", "left").select("qid", "grp", "at", "j", "n", F.explode(F.sequence(F.lit(0), F.coalesce("most", F.lit(0)).cast("int"))).alias("f"))
    starts = materialise(met.select("qid", "grp", (F.col("at") - F.col("j") + F.col("f")).alias("place"), "n").where("place >= 0").distinct(), "starts", True)
    # the text from there on, in slices of blocks
    last = F.col("first") + F.size("words") - 1
    slices = text.select("grp", "ord", "pid", "words", "first", F.size("words").alias("total"), F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(last / BLOCK))).alias("block"))
    lo, hi = F.greatest(F.col("first"), F.col("block") * BLOCK), F.least(last, F.col("block") * BLOCK + BLOCK - 1)
    slices = slices.select(F.col("grp").alias("of"), "block", "ord", "pid", "total", "first", lo.alias("lo"), F.slice("words", (lo - F.col("first") + 1).cast("int"), (hi - lo + 1).cast("int")).alias("words"))
    blocks = starts.withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / BLOCK), F.floor((F.col("place") + F.col("n") - 1) / BLOCK))))
    opened = _sent(blocks.select(F.col("grp").alias("at_grp"), F.col("block").alias("at_block")).distinct(), "opened")
    slices = slices.join(opened, (F.col("block") == F.col("at_block")) & F.col("of").eqNullSafe(F.col("at_grp")), "left_semi")
    # of a block only what lies in the quotation's reach
    skip = F.greatest(F.col("place") - F.col("lo"), F.lit(0))
    reach = blocks.join(slices, (blocks["block"] == slices["block"]) & F.col("grp").eqNullSafe(F.col("of"))).where((F.col("lo") < F.col("place") + F.col("n")) & (F.col("lo") + F.size("words") > F.col("place")))
    part = F.struct((F.col("lo") + skip).alias("lo"), "ord", "pid", "total", "first", F.slice("words", (skip + 1).cast("int"), F.col("n")).alias("words"))
    whole = reach.groupBy("qid", "grp", "place").agg(F.array_sort(F.collect_list(part)).alias("parts")).join(asked.select("qid", F.col("words").alias("q"), "joined"), "qid")
    found = whole.withColumn("ws", F.flatten("parts.words")).withColumn("n", _covered("ws", "q", "joined")).where("n is not null")
    each = found.select("qid", "grp", "place", "n", F.explode("parts").alias("p")).where(F.col("p.lo") < F.col("place") + F.col("n"))
    count = F.least(F.col("p.lo") + F.size("p.words"), F.col("place") + F.col("n")) - F.col("p.lo")
    return each.groupBy("qid", "grp", "place", "p.pid", "p.ord", F.col("p.total").alias("words")).agg(F.min(F.col("p.lo") - F.col("p.first")).alias("at"), F.sum(count).alias("count"))


def quoted_passages(places: DataFrame) -> DataFrame:
    """qid, grp, ord, pid, positions and whole: the passages that a quotation touches at any of its places, and whether it covers one entirely."""
    rows = places.select("qid", "grp", "ord", "pid", "words", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("count") - 1)).alias("pos"))
    per = rows.groupBy("qid", "grp", "ord", "pid", "words").agg(F.array_sort(F.collect_set(F.col("pos").cast("int"))).alias("positions"))
    return per.select("qid", "grp", "ord", "pid", "positions", (F.size("positions") == F.col("words")).alias("whole"))
