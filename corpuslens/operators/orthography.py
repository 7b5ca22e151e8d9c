"""Words that are drawn in more than one way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import arabic

from .ordered import last_before, running_sum


def _drawn(tokens: DataFrame) -> DataFrame:
    """Adds the drawn skeleton, the one as read (both without proclitics before the article) and the lemma."""
    bare = lambda k: F.regexp_replace(k, "^[وفبكل]{1,2}(?=ال..)", "")
    return tokens.withColumn("rasm", bare(arabic.rasm_key(F.col("orig")))).withColumn("pron", bare(arabic.pron_key(F.col("orig")))).withColumn("lemma", F.coalesce("lemma", "pron"))


def variants(tokens: DataFrame) -> DataFrame:
    """Words (as read, by lemma) with several drawn skeletons: id, total, groups, and each form with its count and first and last place."""
    at = F.struct("grp", "ord", "pos")
    forms = _drawn(tokens).groupBy("pron", "lemma", "rasm").agg(F.count("*").alias("count"), F.min_by("orig", at).alias("display"), F.min(at).alias("first"), F.max(at).alias("last"), F.collect_set("grp").alias("grps"))
    words = forms.groupBy("pron", "lemma").agg(F.sum("count").alias("total"), F.size(F.array_distinct(F.flatten(F.collect_list("grps")))).alias("groups"), F.sort_array(F.collect_list(F.struct("count", "rasm", "display", "first", "last")), asc=False).alias("forms"))
    return words.where(F.size("forms") >= 2).select(F.concat_ws("|", "pron", "lemma").alias("id"), "pron", "lemma", "total", "groups", "forms")


def _switches(tokens: DataFrame, word_id: str) -> DataFrame:
    """The occurrences of a word, and whether the writing switches there from the one before, found in ranges of the reading order."""
    rows = _drawn(tokens).where(F.concat_ws("|", "pron", "lemma") == word_id).select("grp", "ord", "pid", "pos", "rasm", "orig")
    marked = last_before(rows, [F.col("grp"), F.col("ord"), F.col("pos")], "rasm", "last")
    return marked.withColumn("switch", F.coalesce(F.col("rasm") != F.col("last"), F.lit(False))).drop("last")


def profile(tokens: DataFrame, word_id: str) -> DataFrame:
    """A word's forms in reading order: count, longest run, and the places where the writing switches to it."""
    marked = _switches(tokens, word_id).withColumn("n", F.col("switch").cast("int"))
    numbered_runs = running_sum(marked, [F.col("grp"), F.col("ord"), F.col("pos")], "n", "before").withColumn("run", F.col("before") + F.col("n"))
    runs = numbered_runs.groupBy("rasm", "run").agg(F.count("*").alias("n"), F.min(F.struct("grp", "ord", "pos")).alias("start"), F.max("n").alias("switch"))
    return runs.groupBy("rasm").agg(F.sum("n").alias("count"), F.max("n").alias("longest_run"), F.array_sort(F.collect_list(F.when(F.col("switch") == 1, F.col("start")))).alias("switches"))


def defective(tokens: DataFrame, closed_class: tuple[str, ...] = ()) -> DataFrame:
    """Forms whose long a is not written: as a dagger, or on a waw; without those whose only one is a final maqsura, and a closed class of norms that modern spelling leaves defective too."""
    v, d = "[ً-ٟ]*", arabic.DAGGER
    waw = F.col("orig").rlike("و" + v + d)
    dagger = F.regexp_replace("orig", "[وى]" + v + d, "").contains(d)
    rows = tokens.select("orig", "grp", arabic.rasm_key(F.col("orig")).alias("rasm"), arabic.pron_key(F.col("orig")).alias("plene"), F.when(waw, "waw").when(dagger, "dagger").alias("category"), arabic.norm(F.col("orig")).alias("n")).where("category is not null")
    if closed_class:
        rows = rows.where(~F.col("n").isin(*closed_class))
    return rows.groupBy("rasm", "plene", "category").agg(F.count("*").alias("count"), F.countDistinct("grp").alias("groups"))


def timeline(tokens: DataFrame, word_id: str) -> DataFrame:
    """The occurrences of a word of several forms: grp, ord, pid, pos, rasm, orig, and whether the writing switches there."""
    return _switches(tokens, word_id)


def forms_by_group(tokens: DataFrame, word_id: str) -> DataFrame:
    """How often each form of a word occurs in each group, and in how many passages."""
    rows = _drawn(tokens).where(F.concat_ws("|", "pron", "lemma") == word_id)
    return rows.groupBy("grp", "rasm").agg(F.count("*").alias("count"), F.countDistinct("pid").alias("passages"))


def defective_profile(tokens: DataFrame, rasm: str, plene: str) -> DataFrame:
    """Where a form without its long a occurs: grp, count and the passages with the places in each, in reading order."""
    rows = tokens.where((arabic.rasm_key(F.col("orig")) == rasm) & (arabic.pron_key(F.col("orig")) == plene))
    passages = rows.groupBy("grp", "ord", "pid").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return passages.groupBy("grp").agg(F.sum(F.size("positions")).alias("count"), F.array_sort(F.collect_list(F.struct("ord", "pid", "positions"))).alias("passages"))


def located(tokens: DataFrame, canon: DataFrame) -> DataFrame:
    """rule, form, pid and pos of the words that stand for a canonical form or an alternate of it.

    Forms of several words are found where words that match them follow one another. A word matches if its drawn skeleton,
    or a stem of it, is that of the form's word; words of a form of one letter don't count.
    """
    spellings = canon.select("rule", "form", F.explode(F.concat(F.array("form"), F.coalesce("alternates", F.array().cast("array<string>")))).alias("spelling"))
    keys = F.filter(F.transform(F.split(F.trim("spelling"), r"\s+"), arabic.rasm_key), lambda k: F.length(k) >= 2)
    asked = spellings.select("rule", "form", "spelling", F.size(keys).alias("n"), F.posexplode(keys).alias("j", "key"))
    drawn = arabic.rasm_key(F.col("orig"))
    stems = tokens.where(F.length(drawn) >= 2).select("pid", "pos", F.explode(F.array_distinct(F.concat(F.array(drawn), arabic.de_affix(drawn)))).alias("key"))
    starts = asked.join(stems, "key").groupBy("rule", "form", "spelling", "n", "pid", (F.col("pos") - F.col("j")).alias("start")).agg(F.countDistinct("j").alias("matched")).where("matched = n")
    return starts.select("rule", "form", "pid", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()


def reconcile(tokens: DataFrame, canon: DataFrame) -> DataFrame:
    """How many words of the tokens stand for each canonical form (rule, form, alternates, modern), and whether modern spelling differs.

    Modern spelling may be two readings with a slash between, of which the first counts. Forms without a modern spelling
    differ, as do those that a column ``keep`` marks, if there is one.
    """
    found = located(tokens, canon).groupBy("rule", "form").agg(F.count("*").alias("found"))
    modern = F.trim(F.split(F.coalesce("modern", F.lit("")), "/")[0])
    differs = (modern == "") | (arabic.rasm_key(F.col("form")) != arabic.rasm_key(modern))
    if "keep" in canon.columns:
        differs = F.coalesce("keep", F.lit(False)) | differs
    return canon.join(found, ["rule", "form"], "left").select("rule", "form", "modern", F.coalesce("found", F.lit(0)).alias("found"), differs.alias("differs"))
