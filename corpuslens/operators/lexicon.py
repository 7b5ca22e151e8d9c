"""Matching of roots with dictionary headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import arabic


def match_headers(roots: DataFrame, headers: DataFrame) -> DataFrame:
    """root and the header it is found under: as it is, with a doubled letter once, by folded form, by both; the first that is there counts, a root without one has null."""
    h = headers.select("header").distinct()
    forms = F.array(F.col("root"), arabic.collapse_geminate(F.col("root")), arabic.match_norm(F.col("root")), arabic.match_norm(arabic.collapse_geminate(F.col("root"))))
    asked = roots.select("root").distinct().select("root", F.posexplode(forms).alias("tier", "form"))
    known = h.select("header", F.explode(F.array(F.struct(F.lit(0).alias("folded"), F.col("header").alias("form")), F.struct(F.lit(1).alias("folded"), arabic.match_norm(F.col("header")).alias("form")))).alias("k")).select("header", "k.folded", "k.form")
    met = asked.join(known, "form").where((F.col("tier") >= 2).cast("int") == F.col("folded"))
    best = met.groupBy("root").agg(F.min(F.struct("tier", "header")).alias("b")).select("root", F.col("b.header").alias("header"), F.col("b.tier").alias("tier"))
    return roots.select("root").distinct().join(best, "root", "left")


def lexicon_coverage(matched: DataFrame) -> DataFrame:
    """Roots, those found, and their share, for each lexicon."""
    return matched.groupBy("lexicon").agg(F.count("*").alias("roots"), F.count("header").alias("found"), (F.count("header") / F.count("*")).alias("share"))


def search_glosses(entries: DataFrame, text: str, top: int = 60) -> DataFrame:
    """Roots whose gloss has a text, by the number of lexicons that agree."""
    return entries.where(F.col("concise").contains(text)).groupBy("root").agg(F.countDistinct("lexicon").alias("lexicons")).orderBy(F.desc("lexicons"), "root").limit(top)
