"""Operators on annotated tokens, Arabic keys, orthography and dictionaries, over small corpora written here, with the rows
that follow from the operators' definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import arabic, typed
from corpuslens.operators import counts, dossiers, expressions, graph, lexicon, morphology, orthography, search, similarity
from corpuslens.operators import tokens as tk
from corpuslens.sources import sinks

#: By name: what makes the rows, the columns, and the rows.
CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], list[str], list[tuple]]] = {}

M = "struct<pos:string,vf:int,aspect:string,voice:string,mood:string,person:int,gender:string,number:string,gcase:string,lemma:string,root:string>"
TOKENS = f"pid string, grp long, ord long, pos int, orig string, norm string, key string, lemma string, root string, m {M}"


def inline(name: str, columns: str, rows: list[tuple]) -> Callable[[Callable[[SparkSession], DataFrame]], None]:
    def add(f: Callable[[SparkSession], DataFrame]) -> None:
        CASES[name] = f, [c.split()[0] for c in columns.split(", ")], rows

    return add


def analysis(pos=None, person=0, case=None, lemma=None, root=None, number=None, gender=None, aspect=None, voice=None, vf=0) -> tuple:
    return (pos, vf, aspect, voice, None, person, gender, number, case, lemma, root)


def corpus(spark: SparkSession, passages: dict) -> DataFrame:
    """passages: {(grp, ord): [(form, analysis), ...]}"""
    return spark.createDataFrame([(f"{g}:{o}", g, o, i, f, f, f, m[9], m[10], m) for (g, o), ws in passages.items() for i, (f, m) in enumerate(ws)], TOKENS)


def plain(spark: SparkSession, passages: dict) -> DataFrame:
    """Words without analyses; their first two letters are their roots."""
    return spark.createDataFrame([(f"{g}:{o}", g, o, i, w, w, w, None, w[:2], None) for (g, o), text in passages.items() for i, w in enumerate(text.split())], TOKENS)


def _joined(c: str | Column, by: str = " ") -> Column:
    return F.array_join(c, by)


# --- keys of words --------------------------------------------------------------------------------------------------------


def _keys(spark: SparkSession, words: list[str], **columns: Callable[[Column], Column]) -> DataFrame:
    df = spark.createDataFrame([(w,) for w in words], "word string")
    return df.select("word", *[f(F.col("word")).alias(name) for name, f in columns.items()])


@inline("sf01_norms", "word varchar, loose varchar, strict varchar", [("ٱلرَّحْمَٰنِ", "الرحمن", "الرحمن"), ("إِيَّاكَ", "اياك", "اياك"), ("مُوسَىٰ", "موسي", "موسى"), ("رَحْمَةٍ", "رحمه", "رحمة"), ("یک", "يك", "يك"), ("abc", "", ""), ("ﻻ", "لا", "لا"), ("ﷲ", "الله", "الله"), ("ﺳﻼﻡ", "سلام", "سلام")])
def _(spark):
    return _keys(spark, ["ٱلرَّحْمَٰنِ", "إِيَّاكَ", "مُوسَىٰ", "رَحْمَةٍ", "یک", "abc", "ﻻ", "ﷲ", "ﺳﻼﻡ"], loose=arabic.norm, strict=arabic.norm_strict)


@inline("sf04_forgiving_keys", "word varchar, long_a varchar, fuzzy varchar", [("ٱلسَّلَٰم", "السلام", "السلم السلام"), ("ٱلصَّلَوٰة", "الصلاه", "الصلوه الصلاه"), ("جِئْنَا", "جينا", "جنا")])
def _(spark):
    long_or_short = lambda w: F.when(F.size(arabic.fuzzy_keys(w)) == 1, arabic.fuzzy_keys(w)).otherwise(F.array(arabic.norm(w), arabic.search_alef(w)))
    return _keys(spark, ["ٱلسَّلَٰم", "ٱلصَّلَوٰة", "جِئْنَا"], long_a=arabic.search_alef, fuzzy=lambda w: _joined(F.when(w == "جِئْنَا", arabic.fuzzy_keys(w)).otherwise(long_or_short(w))))


@inline("sf10_stems", "word varchar, stems varchar", [("والجن", "الجن جن"), ("الجن", "جن"), ("جن", ""), ("من", "")])
def _(spark):
    return _keys(spark, ["والجن", "الجن", "جن", "من"], stems=lambda w: _joined(F.array_sort(arabic.de_affix(w))))


@inline("sf13_latin_skeletons", "word varchar, skeleton varchar", [("shaytan", "sytn"), ("Jibril", "jbrl"), ("yusuf", "ysf"), ("Rahman", "rhmn"), ("cap", "kb"), ("al-baqara", "lbkr"), ("vizier", "fzr"), ("nuuh", "nh"), ("thaqeel", "tkyl"), ("bayt", "byt"), ("noor", "nwr"), ("ghafur", "gfr"), ("daaud", "dwd")])
def _(spark):
    return _keys(spark, ["shaytan", "Jibril", "yusuf", "Rahman", "cap", "al-baqara", "vizier", "nuuh", "thaqeel", "bayt", "noor", "ghafur", "daaud"], skeleton=arabic.latin_skeleton)


@inline("sf13_arabic_skeletons", "word varchar, skeleton varchar", [("شيطن", "stn"), ("جبريل", "jbrl"), ("يوسف", "ysf"), ("وجد", "wjd"), ("غفور", "gfr"), ("البقره", "lbkrh"), ("ممدد", "md"), ("عاد", "d")])
def _(spark):
    return _keys(spark, ["شيطن", "جبريل", "يوسف", "وجد", "غفور", "البقره", "ممدد", "عاد"], skeleton=arabic.arabic_skeleton)


@inline("sf14_typed_letters", "word varchar, letters varchar", [("kt'ab", "كثاب"), ("Hmd", "حمد"), ("'x", "ء"), ("s'ms", "شمس"), ("Bab", "باب")])
def _(spark):
    return _keys(spark, ["kt'ab", "Hmd", "'x", "s'ms", "Bab"], letters=typed.typed_arabic)


@inline("sf16_endings", "word varchar, rhyme varchar, rawiy varchar", [("x ٱلْعَٰلَمِينَ", "ين", "ن"), ("ٱلرَّحِيمِ", "يم", "م"), ("ٱلْهُدَىٰ", "ا", "ا"), ("ضُحَىٰهَا", "ها", "ه")])
def _(spark):
    return _keys(spark, ["x ٱلْعَٰلَمِينَ", "ٱلرَّحِيمِ", "ٱلْهُدَىٰ", "ضُحَىٰهَا"], rhyme=arabic.rhyme_key, rawiy=arabic.rawiy_key)


@inline("sf18_prosody", "word varchar, cv varchar, radf boolean, tasis boolean, place integer", [("ٱلرَّحِيمِ", "VCCCVC", True, False, 7)])
def _(spark):
    p = lambda name: lambda w: arabic.final_prosody(w)[name]
    return _keys(spark, ["ٱلرَّحِيمِ"], cv=p("cv"), radf=p("radf"), tasis=p("tasis"), place=lambda w: arabic.place_of(arabic.rawiy_key(w)))


@inline("sf20_roots", "word varchar, geminate varchar, header varchar", [("مدد", "مد", "مدد"), ("كتب", "كتب", "كتب"), ("سأل", "سأل", "سال"), ("دعو", "دعو", "دعى")])
def _(spark):
    return _keys(spark, ["مدد", "كتب", "سأل", "دعو"], geminate=arabic.collapse_geminate, header=arabic.match_norm)


@inline("sf21_tags", "tags varchar, root varchar, pos varchar, vf integer, aspect varchar, voice varchar, person integer, gender varchar, number varchar, gcase varchar", [
    ("ROOT:qwl|LEM:qaAla|VF:1|PERF|3MP", "qwl", "verb", 1, "perf", "act", 3, "m", "p", None), ("PN|GEN|FS", None, "pn", 0, None, None, 0, "f", "s", "gen"),
    ("PREF", None, "particle", 0, None, None, 0, None, None, None), ("IMPF|PASS|MOOD:JUS|2D", None, "verb", 0, "impf", "pass", 2, None, "d", None)])
def _(spark):
    df = spark.createDataFrame([("ROOT:qwl|LEM:qaAla|VF:1|PERF|3MP", "V"), ("PN|GEN|FS", "N"), ("PREF", "P"), ("IMPF|PASS|MOOD:JUS|2D", "V")], "tags string, c string")
    return df.select("tags", arabic.parse_tags(F.col("tags"), F.col("c")).alias("m")).select("tags", "m.*")


@inline("sf22_spaced_root", "word varchar, root varchar", [("باب (ك ت ب) ms12", "كتب"), ("none", None)])
def _(spark):
    return _keys(spark, ["باب (ك ت ب) ms12", "none"], root=arabic.spaced_root)


@inline("sf28_state", "state varchar", [('{"q":"x"}',)])
def _(spark):
    return spark.range(1).select(typed.state(q=F.lit("x"), n=F.lit(None).cast("int")).alias("state"))


@inline("sc06_shards", "word varchar, shard bigint", [("abc", 0x1A47E90B % 64), ("", 0x811C9DC5 % 64)])
def _(spark):
    return _keys(spark, ["abc", ""], shard=lambda w: typed.shard_of(w).cast("long"))


@inline("ag13_form_and_openings", "form varchar, letters varchar", [("", "ا ل م"), ("IV", None), ("12", "ح م ع س ق")])
def _(spark):
    df = spark.createDataFrame([(0, 2), (4, 5), (12, 42)], "f int, g int")
    return df.select(typed.form_roman(F.col("f")).alias("form"), _joined(typed.opening_letters(F.col("g"))).alias("letters"))


# --- tokens and annotations -----------------------------------------------------------------------------------------------

_SEGMENTS = [("1:1", 1, 1, "wa", "P", "PREF"), ("1:1", 1, 2, "qul", "V", "ROOT:qwl|LEM:qaAla|IMPV|2MS"), ("1:1", 2, 1, "بِ", "P", "P|PREF|LEM:ب"), ("1:1", 2, 2, "ٱل", "P", "DET|PREF"), ("1:1", 2, 3, "حَقِّ", "N", "ROOT:حقق|LEM:حَقّ|MS|GEN"), ("1:1", 3, 1, "hu", "N", "PRON|3MS|SUFF")]


@inline("ex01_words_from_segments", "word integer, form varchar, root varchar, pos varchar, person integer, prep varchar, det boolean", [(1, "waqul", "qwl", "verb", 2, None, False), (2, "بِٱلحَقِّ", "حقق", "noun", 0, "ب", True), (3, "hu", None, "pron", 3, None, False)])
def _(spark):
    seg = spark.createDataFrame(_SEGMENTS, "pid string, word int, seg int, form string, pos_class string, features string")
    return morphology.words_from_segments(seg).select("word", "form", "m.root", "m.pos", "m.person", "prep", "det")


@inline("jn01_attach_morphology", "key varchar, pos varchar", [("aa", "noun"), ("bb", "verb"), ("cc", None), ("dd", None)])
def _(spark):
    m = spark.createDataFrame([("1:1", 0, analysis("noun")), ("1:1", 1, analysis("verb")), ("1:2", 0, analysis("noun"))], f"pid string, pos int, m {M}")
    return tk.attach_morphology(plain(spark, {(1, 1): "aa bb", (1, 2): "cc dd"}).drop("m"), m).select("key", F.col("m.pos").alias("pos"))


@inline("jn02_align_words", "pid varchar, pos integer, word integer", [("1:1", 0, 5), ("1:1", 1, 6), ("1:2", 0, 8), ("1:2", 1, 9), ("1:2", 2, 8)])
def _(spark):
    c = spark.createDataFrame([("1:1", 5, "xx"), ("1:1", 6, "yy"), ("1:2", 9, "dd"), ("1:2", 8, "cc")], "pid string, word int, form string")
    return tk.align_words(plain(spark, {(1, 1): "aa bb", (1, 2): "cc dd cc"}), c)


@inline("jn03_annotate", "key varchar, root varchar, lemma varchar", [("aa", "RR", "LL"), ("bb", None, None)])
def _(spark):
    t = plain(spark, {(1, 1): "aa bb"}).drop("lemma", "root")
    return tk.annotate(t, spark.createDataFrame([("aa", "RR")], "norm string, root string"), spark.createDataFrame([("aa", "LL")], "norm string, lemma string"))


_ROLES = {(1, 1): [("يا", analysis("particle")), ("رب", analysis("noun", case="nom")), ("من", analysis("particle")), ("بيت", analysis("noun", case="gen")), ("عظيم", analysis("noun", case="gen")), ("راي", analysis("verb")), ("رجلا", analysis("noun", case="acc")), ("و", analysis("particle")), ("ولد", analysis("noun", case="acc"))]}


@inline("sm20_roles", "pos integer, role varchar, confidence varchar", [(0, "particle", "high"), (1, "vocative", "high"), (2, "particle", "high"), (3, "prepositional", "high"), (4, "annexed", "high"), (5, "verb", "high"), (6, "object", "high"), (7, "particle", "high"), (8, "conjoined", "high")])
def _(spark):
    return morphology.roles(corpus(spark, _ROLES))


@inline("ag15_role_breakdown", "role varchar, count bigint, share double, first integer", [(r, n, round(n / 9, 6), first) for r, n, first in (("particle", 3, 0), ("vocative", 1, 1), ("prepositional", 1, 3), ("annexed", 1, 4), ("verb", 1, 5), ("object", 1, 6), ("conjoined", 1, 8))])
def _(spark):
    return morphology.role_breakdown(morphology.roles(corpus(spark, _ROLES))).select("role", "count", F.round("share", 6).alias("share"), F.col("examples")[0]["pos"].alias("first"))


def _speech(person, number="s", aspect="perf"):
    return ("x", analysis("verb", person, number=number, gender="m", aspect=aspect, voice="act"))


_SPEECH = {(1, 1): [_speech(3)], (1, 2): [("n", analysis("noun"))], (1, 3): [_speech(2), _speech(1)], (1, 4): [_speech(1, "p")], (1, 5): [_speech(1, "p", "impf")]}


@inline("sm15_register_shifts", "a bigint, b bigint, type varchar, before varchar, after varchar", [(1, 3, "person", "3", "1"), (3, 4, "number", "s", "p"), (4, 5, "aspect", "perf", "impf")])
def _(spark):
    return morphology.register_shifts(corpus(spark, _SPEECH)).withColumnsRenamed({"from": "before", "to": "after"})


@inline("sm16_segment_shifts", "a bigint, b bigint, type varchar, before varchar, after varchar", [(2, 3, "person", "3", "2"), (3, 4, "person", "2", "1"), (4, 5, "aspect", "perf", "impf")])
def _(spark):
    return morphology.segment_shifts(corpus(spark, _SPEECH)).withColumnsRenamed({"from": "before", "to": "after"})


@inline("sm17_rhetoric", "pid varchar, kind varchar, marker varchar", [("1:1", "oath", "والشمس"), ("1:1", "conditional", "اذا"), ("1:2", "oath", "اقسم"), ("1:3", "conditional", "لو")])
def _(spark):
    return morphology.rhetoric(corpus(spark, {(1, 1): [("والشمس", analysis("noun")), ("اذا", analysis("particle"))], (1, 2): [("اقسم", analysis("verb", root="قسم", vf=4))], (1, 3): [("لو", analysis("particle")), ("اذا", analysis("particle"))]}))


def _rooted(text: str) -> list[tuple]:
    return [(w, analysis(root=None if w in ("لا", "بل", "x") else w)) for w in text.split()]


#: Units: 1:1 sets رشد with غوي and نور with ظلم; 1:2 has five roots before its adversative; 1:3 has its adversative in the next passage; 2:1 has no negation.
_ANTITHESIS = {(1, 1): _rooted("رشد لا نور بل غوي ظلم"), (1, 2): _rooted("لا ا ب ت ث ج بل ح"), (1, 3): _rooted("لا موت"), (1, 4): _rooted("بل حيي"), (2, 1): _rooted("نور بل ظلم"), (3, 1): _rooted("لا موت بل حيي")}


@inline("sm21_antithesis_frames", "a varchar, b varchar, frames bigint, passages bigint", [("رشد", "غوي", 1, 1), ("ظلم", "نور", 1, 1), ("غوي", "نور", 1, 1), ("حيي", "موت", 2, 2)])
def _(spark):
    return morphology.antithesis_frames(corpus(spark, _ANTITHESIS))


def _pairs_of(spark, a, b):
    t = corpus(spark, {(1, 1): _rooted("موت بل حيي"), (1, 3): _rooted("حيي"), (2, 1): _rooted("ليل"), (2, 4): _rooted("نهر"), (2, 9): _rooted("ليل"), (3, 1): _rooted("سمو"), (4, 1): _rooted("ارض"), (4, 2): _rooted("ارض x")})
    return morphology.pair_evidence(t, a, b)


@inline("ag23_evidence_same", "pid varchar, level integer", [("1:1", 1)])
def _(spark):
    return _pairs_of(spark, "موت", "حيي")


@inline("ag23_evidence_near", "pid varchar, level integer", [("2:1", 2), ("2:4", 2)])
def _(spark):
    return _pairs_of(spark, "ليل", "نهر")


@inline("ag23_evidence_sample", "pid varchar, level integer", [("3:1", 3), ("4:1", 3), ("4:2", 3)])
def _(spark):
    return _pairs_of(spark, "سمو", "ارض")


@inline("ag23_evidence_none", "pid varchar, level integer", [("", 0)])
def _(spark):
    return spark.createDataFrame([("", 0)], "pid string, level int").unionByName(_pairs_of(spark, "سمو", "zzz").select("pid", "level"))


_FRAMED = [("p", "q", 2), ("حيي", "موت", 1)]


def _relations(spark):
    curated = spark.createDataFrame([("موت", "حيي", "life"), ("a", "b", "x")], "a string, b string, cat string")
    return morphology.relations(curated, spark.createDataFrame(_FRAMED, "a string, b string, frames long"))


@inline("ex11_relations", "a varchar, b varchar, cat varchar, polarity varchar, frames bigint", [("حيي", "موت", "life", "opposite", 1), ("a", "b", "x", "opposite", 0), ("p", "q", None, "candidate", 2)])
def _(spark):
    return _relations(spark)


@inline("ex11_relations_of_root", "other varchar, polarity varchar, cat varchar, frames bigint", [("حيي", "opposite", "life", 1)])
def _(spark):
    return morphology.relations_of(_relations(spark), "موت")


@inline("sf25_definite", "word varchar, definite varchar", [("ٱلْبَيْت", "true"), ("بيت", "false"), ("للناس", "false"), ("وبالبيت", "true"), ("محمد", "true"), ("راي", "false"), ("فكالبيت", "true")])
def _(spark):
    rows = [("ٱلْبَيْت", "noun"), ("بيت", "noun"), ("للناس", "noun"), ("وبالبيت", "noun"), ("محمد", "pn"), ("راي", "verb"), ("فكالبيت", None)]
    return spark.createDataFrame(rows, "word string, p string").select("word", morphology.definite(F.col("word"), F.struct(F.col("p").alias("pos"))).cast("string").alias("definite"))


# --- expressions ----------------------------------------------------------------------------------------------------------


def _expressions(spark: SparkSession) -> DataFrame:
    """Three passages "they believed in-God, a day of religion" with ب in one word with God, and one without a preposition."""
    ws = [("امنوا", analysis("verb", lemma="امن", root="امن", aspect="perf", voice="act")), ("بالله", analysis("pn", lemma="الله", root="اله", case="gen")), ("يوم", analysis("noun", lemma="يوم", root="يوم", case="acc")), ("دين", analysis("noun", lemma="دين", root="دين", case="gen"))]
    t = corpus(spark, {(1, i): ws for i in range(1, 4)} | {(2, 1): [ws[0], ("x", analysis("particle")), ws[2]]})
    return t.withColumn("prep", F.when(F.col("norm") == "بالله", "ب")).withColumn("det", F.col("norm") == "بالله")


@inline("jn10_frame_occurrences", "pid varchar, head varchar, head_pos varchar, root varchar, prep varchar, head_idx integer, prep_idx integer", [(f"1:{i}", "امن", "verb", "امن", "ب", 0, 1) for i in (1, 2, 3)])
def _(spark):
    return expressions.frame_occurrences(_expressions(spark))


@inline("ex02_frames", "head varchar, head_pos varchar, prep varchar, count bigint", [("امن", "verb", "ب", 3)])
def _(spark):
    return expressions.frames(expressions.frame_occurrences(_expressions(spark)))


@inline("ex06_frame_contrast", "head varchar, prep varchar, count bigint", [("امن", "ب", 3), ("امن", "", 1)])
def _(spark):
    t = _expressions(spark)
    return expressions.frame_contrast(expressions.frames(expressions.frame_occurrences(t)), expressions.head_totals(t))


@inline("ex03_verb_nouns", "verb varchar, noun varchar, count bigint", [("امن", "يوم", 1)])
def _(spark):
    return expressions.verb_nouns(_expressions(spark), least=1)


@inline("ex04_genitive_chains", "lemmas varchar, n_words integer, count bigint, first varchar, start integer", [("يوم دين", 2, 3, "1:1", 2)])
def _(spark):
    chains = expressions.genitive_chains(_expressions(spark))
    return chains.select("lemmas", "n_words", "count", F.col("occurrences")[0]["pid"].alias("first"), F.col("occurrences")[0]["start"].alias("start"))


@inline("ex08_valency", "root varchar, preps varchar, governed bigint, bare bigint, objects varchar, object_total bigint", [("amn", "b 211, l 12", 223, 7, "the god 9, day 4", 13), ("ywm", "", 0, 0, "day 4", 4), ("kfr", "b 2", 2, 0, "", 0)])
def _(spark):
    frames = spark.createDataFrame([("amana", "verb", "amn", "b", 171), ("amana", "verb", "amn", "l", 12), ("yumin", "verb", "amn", "b", 40), ("kafara", "verb", "kfr", "b", 2), ("x", "noun", None, "b", 9)], "head string, head_pos string, root string, prep string, count long")
    totals = spark.createDataFrame([("amana", "verb", 188), ("yumin", "verb", 42), ("kafara", "verb", 1)], "head string, head_pos string, total long")
    nouns = spark.createDataFrame([("amana", "amn", "the god", None, 9), ("amana", "amn", "day", "ywm", 4)], "verb string, verb_root string, noun string, noun_root string, count long")
    said = lambda c, name: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x[name], x["count"].cast("string"))), ", ")
    return expressions.valency(frames, totals, nouns).select("root", said("preps", "prep").alias("preps"), "governed", "bare", said("objects", "noun").alias("objects"), "object_total")


@inline("ex09_construction", "pid varchar, particle varchar, object varchar, definite boolean", [("2:1", None, "يوم", False)])
def _(spark):
    t = _expressions(spark)
    return expressions.construction(t, expressions.frame_occurrences(t), "امن", prep="ب", present=False)


@inline("ex09_construction_object", "pid varchar, particle varchar, object varchar, definite boolean", [(f"1:{i}", "ب", "بالله", True) for i in (1, 2, 3)])
def _(spark):
    t = _expressions(spark)
    return expressions.construction(t, expressions.frame_occurrences(t), "امن", prep="ب", object_definite=True)


@inline("ex10_facets", "total bigint, preps varchar, aspects varchar, voices varchar", [(4, "ب", "perf", "act")])
def _(spark):
    t = _expressions(spark)
    return expressions.facets(t, expressions.frame_occurrences(t), "امن").select("total", *[_joined(c).alias(c) for c in ("preps", "aspects", "voices")])


@inline("ex08_of_root", "kind varchar, text varchar, count bigint", [("frame", "امن ب", 3), ("collocation", "امن يوم", 1)])
def _(spark):
    t = _expressions(spark)
    return expressions.of_root(expressions.frames(expressions.frame_occurrences(t)), expressions.verb_nouns(t, least=1), "امن")


@inline("ex05_idioms", "idiom varchar, pid varchar, start integer", [("يوم دين", f"1:{i}", 2) for i in (1, 2, 3)])
def _(spark):
    return dossiers.idioms(_expressions(spark), [["يوم", "دين"], ["nothing"]])


@inline("ag20_verb_clusters", "verb varchar, nouns varchar", [("امن", "يوم")])
def _(spark):
    return dossiers.verb_clusters(expressions.verb_nouns(_expressions(spark), least=1)).select("verb", _joined("nouns").alias("nouns"))


@inline("ag19_occurrence_passages", "pid varchar, positions varchar", [(f"1:{i}", "0 1") for i in (1, 2, 3)])
def _(spark):
    marked = dossiers.occurrence_passages(expressions.frame_occurrences(_expressions(spark)), F.array("head_idx", "prep_idx"))
    return marked.select("pid", _joined(F.col("positions").cast("array<string>")).alias("positions"))


@inline("fl04_occurrences_by_analysis", "pid varchar", [("1:1",), ("1:2",), ("1:3",), ("2:1",)])
def _(spark):
    return dossiers.occurrences(_expressions(spark), "امن", "root", counts.morphology_filter(aspect=["perf"]))


@inline("ex13_root_dossier", "section varchar, name varchar, n double", [("distribution", "1", 3.0), ("distribution", "2", 1.0), ("frame", "امن ب", 3.0), ("neighbour", "كفر", 0.5), ("relation", "كفر", 2.0), ("passages", "امن", 4.0)])
def _(spark):
    t = _expressions(spark)
    near = spark.createDataFrame([("امن", "كفر", 0.5)], "key string, near string, sim double")
    rel = spark.createDataFrame([("امن", "كفر", 2)], "a string, b string, frames long")
    rows = dossiers.root_dossier(t, t.select("grp"), "امن", near, rel)
    return rows.where(F.col("section").isin("distribution", "frame", "neighbour", "relation", "passages")).select("section", "name", F.col("n").cast("double").alias("n"))


@inline("fl03_morphology_catalogue", "key varchar, count bigint, passages bigint", [("امن", 4, 4)])
def _(spark):
    return counts.morphology_catalogue(_expressions(spark), counts.morphology_filter(pos=["verb"], voice=["act"]), "lemma")


@inline("ag05_derivation_family", "lemma varchar, count bigint", [("امن", 4)])
def _(spark):
    return counts.derivation_family(_expressions(spark), "امن")


@inline("ag14_name_counts", "name varchar, form_df bigint, root_df bigint", [("God", 3, 3), ("x", 1, 4)])
def _(spark):
    return counts.name_counts(_expressions(spark), spark.createDataFrame([("God", "بالله", "اله"), ("x", "x", "امن")], "name string, norm string, root string"))


@inline("ag21_tag_counts", "tag varchar, passages bigint", [("a", 1)])
def _(spark):
    tags = spark.createDataFrame([("1:1", "a"), ("1:2", "a"), ("1:2", "b")], "pid string, tag string")
    return counts.tag_counts(tags, _expressions(spark).where("ord = 1 and grp = 1"))


@inline("st04_merge_workspaces", "id bigint, body varchar, tags varchar", [(1, "new", "x y"), (2, "z", "")])
def _(spark):
    w = "id long, body string, tags array<string>, updated long"
    merged = counts.merge_workspaces(spark.createDataFrame([(1, "old", ["x"], 1)], w), spark.createDataFrame([(1, "new", ["y"], 2), (2, "z", [], 1)], w))
    return merged.select("id", "body", _joined("tags").alias("tags"))


@inline("pr01_passage_shape", "pid varchar, text varchar, matches varchar, n_words integer, second varchar", [(f"1:{i}", "امنوا بالله يوم دين", "0", 4, "بالله بالله اله الله pn gen") for i in (1, 2, 3)] + [("2:1", "امنوا x يوم", "0", 3, "x x particle")])
def _(spark):
    shapes = dossiers.passage_shapes(_expressions(spark), "امن", "lemma")
    w = F.col("words")[1]
    second = F.concat_ws(" ", w["form"], w["normalized"], w["root"], w["lemma"], w["morphology"]["pos"], w["morphology"]["gcase"])
    return shapes.select("pid", "text", _joined(F.col("matches").cast("array<string>")).alias("matches"), F.size("words").alias("n_words"), second.alias("second"))


# --- orthography and dictionaries -----------------------------------------------------------------------------------------


def _written(spark: SparkSession) -> DataFrame:
    rows = [("1:1", 1, 1, 0, "إِبْرَٰهِۦمَ"), ("1:2", 1, 2, 0, "إِبْرَٰهِۦمَ"), ("2:1", 2, 1, 0, "إِبْرَٰهِيمَ"), ("2:1", 2, 1, 1, "كتب")]
    return spark.createDataFrame([(*r, None, None) for r in rows], "pid string, grp long, ord long, pos int, orig string, lemma string, root string")


@inline("rs01_variants", "total bigint, groups bigint, forms varchar", [(3, 2, "ابرهم 2, ابرهيم 1")])
def _(spark):
    v = orthography.variants(_written(spark))
    forms = F.array_sort(F.transform("forms", lambda f: F.concat_ws(" ", f["rasm"], f["count"].cast("string"))))
    return v.select("total", "groups", _joined(forms, ", ").alias("forms"))


@inline("rs02_profile", "rasm varchar, longest_run bigint, switches integer", [("ابرهم", 2, 0), ("ابرهيم", 1, 1)])
def _(spark):
    variant = orthography.variants(_written(spark)).first()["id"]
    return orthography.profile(_written(spark), variant).select("rasm", "longest_run", F.size(F.coalesce("switches", F.array())).alias("switches"))


@inline("rs03_defective", "category varchar", [("dagger",)])
def _(spark):
    return orthography.defective(_written(spark)).select("category").distinct()


@inline("rs05_reconcile", "form varchar, found bigint, differs boolean", [("ابرهم", 2, True)])
def _(spark):
    canon = spark.createDataFrame([("r", "ابرهم", "ابراهيم", None), ("r", "zz", "zz", ["كتب"])], "rule string, form string, modern string, alternates array<string>")
    return orthography.reconcile(_written(spark), canon).where("form = 'ابرهم'").select("form", F.col("found").cast("long").alias("found"), "differs")


@inline("rs02_timeline", "pid varchar, rasm varchar, switch boolean", [("1:1", "ابرهم", False), ("1:2", "ابرهم", False), ("2:1", "ابرهيم", True)])
def _(spark):
    return orthography.timeline(_written(spark), orthography.variants(_written(spark)).first()["id"])


@inline("rs02_forms_by_group", "grp bigint, rasm varchar, count bigint, passages bigint", [(1, "ابرهم", 2, 2), (2, "ابرهيم", 1, 1)])
def _(spark):
    return orthography.forms_by_group(_written(spark), orthography.variants(_written(spark)).first()["id"])


@inline("rs04_defective_profile", "grp bigint, count bigint, pids varchar", [(1, 2, "1:1 1:2"), (2, 1, "2:1")])
def _(spark):
    found = [orthography.defective_profile(_written(spark), r["rasm"], r["plene"]) for r in orthography.defective(_written(spark)).select("rasm", "plene").collect()]  # two spellings
    return found[0].unionByName(found[1]).select("grp", "count", _joined(F.transform("passages", lambda p: p["pid"])).alias("pids"))


@inline("rs05_located_words", "form varchar, pid varchar, pos integer", [("كتب ربك", "1:1", 1), ("كتب ربك", "1:1", 2), ("قال", "1:1", 0), ("قال", "1:2", 1), ("مد", "1:2", 0)])
def _(spark):
    t = spark.createDataFrame([("1:1", 0, "قال"), ("1:1", 1, "وكتب"), ("1:1", 2, "ربك"), ("1:2", 0, "مدد"), ("1:2", 1, "فقال"), ("1:2", 2, "كتب"), ("1:3", 0, "كتب")], "pid string, pos int, orig string")
    canon = spark.createDataFrame([("r", "كتب ربك", "", None), ("r", "قال", "قال", None), ("r", "مد", "مد", ["مدد"])], "rule string, form string, modern string, alternates array<string>")
    return orthography.located(t, canon)


def _headers(spark):
    roots = spark.createDataFrame([("كتب",), ("مدد",), ("سأل",), ("xyz",)], "root string")
    return lexicon.match_headers(roots, spark.createDataFrame([("كتب",), ("مد",), ("سال",)], "header string"))


@inline("jn12_match_headers", "root varchar, header varchar, tier varchar", [("كتب", "كتب", "0"), ("مدد", "مد", "1"), ("سأل", "سال", "2"), ("xyz", None, None)])
def _(spark):
    return _headers(spark).withColumn("tier", F.col("tier").cast("string"))


@inline("ex12_lexicon_coverage", "share double", [(0.75,)])
def _(spark):
    return lexicon.lexicon_coverage(_headers(spark).withColumn("lexicon", F.lit("l")))


@inline("fl07_search_glosses", "root varchar, lexicons bigint", [("a", 2), ("b", 1)])
def _(spark):
    return lexicon.search_glosses(spark.createDataFrame([("l1", "a", "to write"), ("l2", "a", "writer"), ("l1", "b", "write")], "lexicon string, root string, concise string"), "write")


# --- search ---------------------------------------------------------------------------------------------------------------


def _searched(spark: SparkSession) -> DataFrame:
    return tk.arabic_tokens(spark.createDataFrame([("1:1", 1, 1, "مِنْ أَهْلِ ٱلْقُرَىٰ"), ("1:2", 1, 2, "أَهْلُ ٱلْبَيْتِ مِنْ"), ("2:1", 2, 1, "وَٱلْجِنَّ"), ("2:2", 2, 2, "أَهْلٌ أَهْلَكَ")], "pid string, grp long, ord long, text string"))


def _alias(t: DataFrame) -> DataFrame:
    return tk.aliases(t.select("orig", "key", F.struct("grp", "ord", "pos").alias("first")))


@inline("sr09_romanised", "key varchar, tier integer, dist integer, df bigint", [("والجن", 3, 0, 1)])
def _(spark):
    t = _searched(spark)
    return search.romanised(t.select("key"), "jinn", tk.document_frequency(t)).where("tier = 3")


@inline("sr10_resolve_direct", "key varchar, source varchar, df bigint, rank integer", [("اهل", "direct", 3, 1), ("اهلك", "alias", 1, 2)])
def _(spark):
    t = _searched(spark)
    return search.resolve_term(_alias(t), "أَهْل", tk.document_frequency(t))


@inline("sr10_resolve_alias", "key varchar, source varchar, df bigint, rank integer", [("والجن", "alias", 1, 1)])
def _(spark):
    t = _searched(spark)
    return search.resolve_term(_alias(t), "الجن", tk.document_frequency(t))


@inline("sr10_resolve_latin", "key varchar, source varchar, df bigint, rank integer", [("والجن", "romanised", 1, 1)])
def _(spark):
    t = _searched(spark)
    return search.resolve_term(_alias(t), "jinn", tk.document_frequency(t)).where("rank = 1")


@inline("sr10_resolve_nothing", "n bigint", [(0,)])
def _(spark):
    t = _searched(spark)
    return search.resolve_term(_alias(t), "ظظظظظظظظ", tk.document_frequency(t)).agg(F.count("*").alias("n"))


@inline("sr13_arabic_phrase", "pid varchar", [("1:2",)])
def _(spark):
    return search.phrase(_searched(spark), ["اهل", "البيت"])


@inline("sr08_full_text_order", "pid varchar, run integer, ordered boolean", [("1:1", 2, True), ("1:3", 1, True), ("1:2", 1, False)])
def _(spark):
    t = plain(spark, {(1, 1): "aa bb zz", (1, 2): "bb aa", (1, 3): "aa cc bb", (1, 4): "cc"})
    return search.full_text(search.content_index(t, False), [["aa"], ["bb"]])


@inline("sr08_full_text_relaxed", "pid varchar", [("1:1",)])
def _(spark):
    t = plain(spark, {(1, 1): "aa bb zz", (1, 2): "bb aa", (1, 3): "aa cc bb", (1, 4): "cc"})
    return search.full_text(search.content_index(t, False), [["zz"], ["qq"]])


@inline("sr12_locate_across", "pid varchar, pos integer", [("1:1", 1)])
def _(spark):
    t = plain(spark, {(1, 1): "aa bb", (1, 2): "ccdd ee", (2, 1): "aa bb"}).withColumn("quote_keys", F.array("key"))
    return search.locate_across(t, [["bb"], ["cc"], ["dd"], ["ee"]])


@inline("sf26_passage_references", "t varchar, grp varchar, ord varchar", [("2:255", "2", "255"), ("2/3", "2", "3"), ("x", None, None)])
def _(spark):
    return spark.createDataFrame([("2:255",), ("2/3",), ("x",)], "t string").select("t", search.verse_key(F.col("t")).alias("k")).select("t", F.col("k.grp").cast("string").alias("grp"), F.col("k.ord").cast("string").alias("ord"))


@inline("sf27_group_index", "alias varchar, grp bigint", [("2", 2), ("albaqara", 2)])
def _(spark):
    g = spark.createDataFrame([(1, "الفاتحة", "al-Fatiha"), (2, "البقرة", "al-Baqara")], "grp long, name string, latin string")
    return search.group_index(g).where("alias in ('2', 'albaqara')")


@inline("sr04_stop_sets", "particles bigint, both bigint, effective bigint", [(80, 92, 91)])
def _(spark):
    effective = tk.stop_set(tk.ARABIC_PARTICLES + tk.ARABIC_CONTENT, extra=("zz",), disabled=("الله", "رب"))
    sizes = [(len(set(tk.ARABIC_PARTICLES)), len(set(tk.ARABIC_PARTICLES + tk.ARABIC_CONTENT)), len(effective))]
    return spark.createDataFrame(sizes, "particles long, both long, effective long")


# --- phrases, differences, graph ------------------------------------------------------------------------------------------


@inline("sm07_shared_phrases_nested", "phrase varchar, n_words integer, others bigint", [("aa bb cc dd ee", 5, 1), ("aa bb cc dd", 4, 2), ("bb cc dd", 3, 3)])
def _(spark):
    return similarity.shared_phrases(plain(spark, {(1, 1): "aa bb cc dd ee", (1, 2): "xx aa bb cc dd yy", (1, 3): "bb cc dd zz", (2, 1): "aa bb cc dd ee ff"}), "1:1")


@inline("sm08_twins", "a varchar, b varchar, same integer, changed integer", [("1:1", "2:1", 5, 1)])
def _(spark):
    return similarity.near_twins(plain(spark, {(1, 1): "aa bb cc dd ee", (1, 2): "xx aa bb cc dd yy", (1, 3): "bb cc dd zz", (2, 1): "aa bb cc dd ee ff"}))


@inline("sm08_twins_of_classes", "a varchar, b varchar, same integer, changed integer", [("1:1", "1:3", 4, 1)])
def _(spark):
    t = plain(spark, {(1, 1): "aa bb cc dd", (1, 2): "aa bb cc dd", (1, 3): "aa bb cc dd ee", (1, 4): "aa bb cc dd"})
    return similarity.near_twins(t, classes=True)


@inline("sm08_same_words", "pid varchar, same_as varchar", [("1:1", "1:1"), ("1:2", "1:1"), ("1:3", "1:3")])
def _(spark):
    return similarity.equal_passages(plain(spark, {(1, 1): "aa bb", (1, 2): "aa bb", (1, 3): "bb aa"}))


@inline("sm09_word_diff", "same integer, changed integer, ratio double, steps varchar", [(2, 2, round(2 / 3, 6), "same a, del b, ins x, same c")])
def _(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"])], "a array<string>, b array<string>")
    steps = df.select(similarity.word_diff(F.col("a"), F.col("b")).alias("d"), similarity.diff_operations("a", "b").alias("ops"))
    return steps.select("d.same", "d.changed", F.round("d.ratio", 6).alias("ratio"), _joined(F.transform("ops", lambda x: F.concat_ws(" ", x["op"], x["word"])), ", ").alias("steps"))


@inline("sm18_kin_of_root", "key varchar, anagram boolean", [("بتك", True), ("كتم", False), ("كب", False)])
def _(spark):
    return similarity.kin(spark.createDataFrame([("كتب",), ("بتك",), ("كتم",), ("نور",), ("كب",)], "key string"), "كتب")


@inline("sm19_seam_of_groups", "a bigint, b bigint, shared_keys varchar, seam varchar", [(1, 2, "aa", "aa zz")])
def _(spark):
    t = plain(spark, {(1, 1): "aa", (1, 2): "zz qq", (2, 1): "zz aa", (3, 1): "mm"})
    return similarity.seams(t, spark.createDataFrame([(1, "aa"), (2, "aa")], "grp long, key string"))


_GRAPH = {(1, 1): "aa bb cc", (1, 2): "aa bb", (1, 3): "aa", (1, 4): "bb", (1, 5): "aa cc"}


@inline("gr01_loops", "source varchar, target varchar", [("bb", "1:2")])
def _(spark):
    return graph.expand(plain(spark, _GRAPH), "1:1", ["aa", "bb"], branch=2)[1].where("kind = 'loop'")


@inline("gr01_nodes", "id varchar, kind varchar, parent varchar", [("1:1", "passage", None), ("1:2", "passage", "aa"), ("1:4", "passage", "bb"), ("1:5", "passage", "aa"), ("more:aa", "more", "aa")])
def _(spark):
    return graph.expand(plain(spark, _GRAPH), "1:1", ["aa", "bb"], branch=2)[0].where("kind <> 'word'")


@inline("gr02_path", "id varchar", [("1:2",), ("aa",), ("1:1",)])
def _(spark):
    tree = graph.expand(plain(spark, _GRAPH), "1:1", ["aa", "bb"], branch=2)[1].where("kind = 'tree'")
    return graph.path_to(tree, "1:2")


# --- projections and citations --------------------------------------------------------------------------------------------


@inline("pr01_passage_view", "pid varchar, matches varchar, words varchar", [("1:1", "0 2", "0 aa aa {\"pos\":\"noun\"}, 1 bb bb {\"pos\":\"verb\",\"vf\":2}, 2 aa aa {}"), ("1:2", None, None)])
def _(spark):
    t = corpus(spark, {(1, 1): [("aa", analysis("noun")), ("bb", analysis("verb", vf=2)), ("aa", analysis())]})
    passages = spark.createDataFrame([("1:1", 1, 1, "aa bb aa"), ("1:2", 1, 2, "")], "pid string, grp long, ord long, text string")
    words = F.transform("words", lambda w: F.concat_ws(" ", w["index"].cast("string"), w["form"], w["normalized"], w["morphology"]))
    return tk.passage_view(passages, t, "aa").select("pid", _joined(F.transform("matches", lambda p: p.cast("string"))).alias("matches"), _joined(words, ", ").alias("words"))


@inline("ag10_dominant_ending", "grp bigint, ending varchar, n bigint", [(1, "na", 2), (2, "xa", 1)])
def _(spark):
    return counts.dominant_ending(similarity.endings(plain(spark, {(1, 1): "aa tuna", (1, 2): "bb", (1, 3): "lina", (2, 1): "xa", (2, 2): "ab"})))


@inline("ag11_passage_analyses", "pid varchar, pos_mix varchar, forms varchar", [("1:1", "noun 1, verb 2", "1 4"), ("1:2", "", "")])
def _(spark):
    t = corpus(spark, {(1, 1): [("aa", analysis("verb", vf=4)), ("bb", analysis("noun")), ("cc", analysis("verb", vf=1))], (1, 2): [("dd", analysis())]})
    mix = F.transform("pos_mix", lambda x: F.concat_ws(" ", x["pos"], x["count"].cast("string")))
    return counts.passage_analyses(t).select("pid", _joined(mix, ", ").alias("pos_mix"), _joined(F.transform("forms", lambda f: f.cast("string"))).alias("forms"))


@inline("sk05_citations", "kind varchar, cited varchar", [
    ("entry_bibtex", "@book{mylexicon2_ktb1863,|  author = {A (d. 1876)},|  title = {T},|  year = {1863},|  volume = {2},|  note = {s.v. ktb, vol. 2}|}|"),
    ("entry_ris", "TY  - BOOK|AU  - A|TI  - T|PY  - 1863|VL  - 2|KW  - ktb|N1  - s.v. ktb, vol. 2|ER  - |"),
    ("result_bibtex", "@misc{k,|  author = {{Me}},|  title = {T}|}|"),
    ("result_ris", "TY  - DATA|AU  - Me|TI  - T|KW  - x|KW  - y|ER  - |"),
])
def _(spark):
    none = F.lit(None).cast("string")
    entry = {"root": F.lit("ktb"), "lexicon": F.lit("My Lexicon 2"), "title": F.lit("{T}"), "author": F.lit("A"), "died": F.lit(1876), "year": F.lit("1863"), "volume": F.lit(2)}
    cited = {
        "entry_bibtex": sinks.entry_bibtex(**entry),
        "entry_ris": sinks.entry_ris(**(entry | {"title": F.lit("T")})),
        "result_bibtex": sinks.result_bibtex("Me", F.lit("k"), F.lit("T"), none, none, none),
        "result_ris": sinks.result_ris("Me", F.lit("T"), none, none, none, F.array(F.lit("x"), F.lit(""), F.lit("y"))),
    }
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("cited")) for k, c in cited.items()])).alias("r"))
    return rows.select("r.kind", F.regexp_replace("r.cited", r"\r?\n", "|").alias("cited"))
