"""Forgiving lookup for a table of terms, over stored neighbourhoods of the forms that may be meant.

Two strings are within an edit distance of k only if deleting at most k letters from each can make them equal. So each form
is stored under all it becomes by at most two deletions, a term is brought to it by its own, and what meets is measured.
A long form has too many deletions; it is stored by thirds instead, of which two edits leave one whole, in its place but
for two letters. Where a term may begin a form or lie in it, they meet by the term's rarest three letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import arabic

#: Edits that are forgiven at most, and letters of a form that is stored by its deletions (some 500 for the longest).
EDITS, SHORT = 2, 32
_FORMS, _GRAMS, _CUTS, _THIRDS = "form string, key string", "gram string, form string", "cut string, deleted int, form string", "length int, third int, part string, form string"


def _deletions(s: str | Column) -> Column:
    """What a string becomes without one of its letters."""
    s = F.col(s) if isinstance(s, str) else s
    cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    return F.when(F.length(s) > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def neighbourhood(s: str) -> Column:
    """(cut, deleted) of all a string becomes by up to EDITS deletions."""
    steps = [F.array(F.col(s))]
    for _ in range(EDITS):
        steps.append(F.array_distinct(F.flatten(F.transform(steps[-1], _deletions))))
    marked = lambda step, d: F.transform(step, lambda c: F.struct(c.alias("cut"), F.lit(d).alias("deleted")))
    return F.concat(*[marked(step, d) for d, step in enumerate(steps)])


def _runs(s: str, n: int) -> Column:
    """The distinct runs of n letters of a string."""
    runs = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(F.col(s), i, F.lit(n)))
    return F.when(F.length(s) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _third(length: Column, i: int) -> tuple[Column, Column]:
    """Where a third of a form of this length begins, from 1, and its length."""
    n = F.floor(length / (EDITS + 1)).cast("int")
    return n * i + 1, (n if i < EDITS else length - n * EDITS)


def write_forms(alias: DataFrame, path: str, stems: bool = False) -> None:
    """Stores the aliases (alias, key) below path: forms (with ``stems`` also those of Arabic words) with keys, letters, deletions and thirds."""
    forms = F.concat(F.array("alias"), arabic.de_affix(F.col("alias"))) if stems else F.array("alias")
    each = alias.select(F.explode(forms).alias("form"), F.col("key").cast("string").alias("key")).where("form != ''").distinct()
    each.write.parquet(f"{path}/forms")
    distinct = alias.sparkSession.read.schema(_FORMS).parquet(f"{path}/forms").select("form").distinct()
    begin = F.concat(F.lit("^"), F.substring("form", 1, 2))
    distinct.select(F.explode(F.concat(_runs("form", 3), _runs("form", 2), F.array(begin))).alias("gram"), "form").write.parquet(f"{path}/grams")
    distinct.where(F.length("form") <= SHORT).select(F.explode(neighbourhood("form")).alias("c"), "form").select("c.cut", "c.deleted", "form").write.parquet(f"{path}/cuts")
    length = F.length("form")
    thirds = F.array(*[F.struct(F.lit(i).alias("third"), F.substr(F.col("form"), *_third(length, i)).alias("part")) for i in range(EDITS + 1)])
    distinct.where(length > SHORT).select(length.alias("length"), F.explode(thirds).alias("t"), "form").select("length", "t.third", "t.part", "form").write.parquet(f"{path}/thirds")


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def containing(spark: SparkSession, path: str, asked: DataFrame, least: int = 3) -> DataFrame:
    """(qid, term, form) of the forms that contain a term of ``least`` letters or more (2 or 3), or begin with one of two."""
    inside = (F.length("term") >= least) | F.col("form").startswith(F.col("term"))
    two = F.array("term") if least == 2 else F.array(F.concat(F.lit("^"), "term"))
    own = asked.where(F.length("term") >= 2).select("qid", "term", F.explode(F.when(F.length("term") == 2, two).otherwise(_runs("term", 3))).alias("gram"))
    grams = _read(spark, path, "grams", _GRAMS)
    frequency = grams.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # of a term's runs the rarest; one that no form has leaves nothing
    rarest = own.join(frequency, "gram", "left").groupBy("qid", "term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    met = rarest.select("qid", "term", F.col("r.gram").alias("gram")).join(grams, "gram")
    return met.where(F.col("form").contains(F.col("term")) & inside).select("qid", "term", "form").distinct()


def within_edits(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(qid, term, form, dist) of the forms within ``edits`` (a column of asked, EDITS at most) of a term."""
    own = asked.where(F.length("term") <= SHORT + EDITS).select("qid", "term", "edits", F.explode(neighbourhood("term")).alias("c")).where("c.deleted <= edits")
    cuts = _read(spark, path, "cuts", _CUTS)
    near = own.select("qid", "term", "edits", "c.cut").join(cuts, "cut").where("deleted <= edits").select("qid", "term", "edits", "form")
    # thirds: the form may be longer or shorter by the edits, and its untouched third as far from its place
    length = F.length("term")
    lengths = asked.where(length > SHORT - EDITS).select("qid", "term", "edits", F.explode(F.sequence(F.greatest(F.lit(SHORT + 1), length - EDITS), length + EDITS)).alias("length")).where(F.col("length") > SHORT)
    shifts = [F.struct(F.lit(i).alias("third"), F.substr(F.col("term"), F.greatest(F.lit(1), _third(F.col("length"), i)[0] + d), _third(F.col("length"), i)[1]).alias("part")) for i in range(EDITS + 1) for d in range(-EDITS, EDITS + 1)]
    parts = lengths.select("qid", "term", "edits", "length", F.explode(F.array_distinct(F.array(*shifts))).alias("t")).select("qid", "term", "edits", "length", "t.third", "t.part")
    long = parts.join(_read(spark, path, "thirds", _THIRDS), ["length", "third", "part"]).select("qid", "term", "edits", "form")
    met = near.unionByName(long).distinct().where(F.abs(F.length("form") - length) <= F.col("edits"))
    return met.withColumn("dist", F.levenshtein("form", "term")).where("dist <= edits").select("qid", "term", "form", "dist")


def resolve_terms(spark: SparkSession, path: str, queries: DataFrame, frequency: DataFrame, *, limit: int | None = 12) -> DataFrame:
    """qid, key, tier, dist, df and rank of what each of the queries (qid, variants) may mean, best first.

    Tier 3: a form of the key is a variant; 2: begins with it; 1: contains it (three letters at least). Only for a query that
    has none of these, tier 0: within an edit distance of 1, or of 2 if its first variant has more than four letters.
    Variants of one letter ask for nothing. ``frequency`` has (key, df); keys without one are left out. ``limit`` best, or all if None.
    """
    edits = F.when(F.length(F.col("variants")[0]) <= 4, 1).otherwise(EDITS)
    asked = queries.where(F.size("variants") > 0).select("qid", edits.alias("edits"), F.explode(F.array_distinct("variants")).alias("term")).where(F.length("term") >= 2)
    tier = F.when(F.col("form") == F.col("term"), 3).when(F.col("form").startswith(F.col("term")), 2).otherwise(1)
    forms = _read(spark, path, "forms", _FORMS)
    known = frequency.select(F.col("key").cast("string").alias("key"), "df")
    met = containing(spark, path, asked).groupBy("qid", "form").agg(F.max(tier).alias("tier"))
    hit = met.join(forms, "form").groupBy("qid", "key").agg(F.max("tier").alias("tier")).join(known, "key").select("qid", "key", "tier", F.lit(0).alias("dist"), "df")
    open_ = asked.join(hit.select("qid").distinct(), "qid", "left_anti")
    near = within_edits(spark, path, open_).groupBy("qid", "form").agg(F.min("dist").alias("dist"))
    guess = near.join(forms, "form").groupBy("qid", "key").agg(F.min("dist").alias("dist")).join(known, "key").select("qid", "key", F.lit(0).alias("tier"), "dist", "df")
    ranked = hit.unionByName(guess).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("tier"), "dist", F.desc("df"), "key")))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def near_names(spark: SparkSession, path: str, queries: DataFrame, *, limit: int | None = 5) -> DataFrame:
    """qid, key, dist and rank of the keys whose names are near each of the queries (qid, name): hints for a name that isn't known.

    Distance 0 where a name contains the query or begins it, else the edit distance up to EDITS; names of one letter ask for nothing.
    """
    asked = queries.select("qid", F.col("name").alias("term"), F.lit(EDITS).alias("edits")).where(F.length("term") >= 2)
    forms = _read(spark, path, "forms", _FORMS)
    within = containing(spark, path, asked, 2).select("qid", "form", F.lit(0).alias("dist"))
    begins = F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substr(F.col("term"), F.lit(1), n))
    begun = asked.select("qid", F.explode(begins).alias("form")).join(forms.select("form").distinct(), "form").select("qid", "form", F.lit(0).alias("dist"))
    near = within_edits(spark, path, asked).select("qid", "form", "dist")
    best = within.unionByName(begun).unionByName(near).join(forms, "form").groupBy("qid", "key").agg(F.min("dist").alias("dist"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "key")))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
