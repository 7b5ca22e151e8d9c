"""Operators on annotated tokens, over small inline corpora."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import arabic
from corpuslens.operators import counts, expressions, graph, lexicon, morphology, orthography, search, similarity
from corpuslens.operators import tokens as tk

M = "struct<pos:string,vf:int,aspect:string,voice:string,mood:string,person:int,gender:string,number:string,gcase:string,lemma:string,root:string>"
TOKENS = f"pid string, grp long, ord long, pos int, orig string, norm string, key string, lemma string, root string, m {M}"


def word(pos=None, person=0, case=None, lemma=None, root=None, number=None, gender=None, aspect=None, voice=None, vf=0):
    return (pos, vf, aspect, voice, None, person, gender, number, case, lemma, root)


def corpus(spark, passages):
    """passages: {(grp, ord): [(form, analysis), ...]}"""
    rows = [(f"{g}:{o}", g, o, i, f, f, f, m[9], m[10], m) for (g, o), ws in passages.items() for i, (f, m) in enumerate(ws)]
    return spark.createDataFrame(rows, TOKENS)


def plain(spark, passages):
    rows = [(f"{g}:{o}", g, o, i, w, w, w, None, w[:2], None) for (g, o), text in passages.items() for i, w in enumerate(text.split())]
    return spark.createDataFrame(rows, TOKENS)


def test_words_from_segments(spark):
    seg = spark.createDataFrame([("1:1", 1, 1, "wa", "P", "PREF"), ("1:1", 1, 2, "qul", "V", "ROOT:qwl|IMPV|2MS"), ("1:1", 2, 1, "hu", "N", "PRON|3MS|SUFF")], "pid string, word int, seg int, form string, pos_class string, features string")
    got = {r.word: r for r in morphology.words_from_segments(seg).collect()}
    assert got[1].form == "waqul" and got[1].m.root == "qwl" and got[1].m.person == 2 and got[2].m.pos == "pron"


def test_morphology_attaches_only_where_counts_agree(spark):
    t = plain(spark, {(1, 1): "aa bb", (1, 2): "cc dd"}).drop("m")
    m = spark.createDataFrame([("1:1", 0, word("noun")), ("1:1", 1, word("verb")), ("1:2", 0, word("noun"))], f"pid string, pos int, m {M}")
    assert {r.key: r.m.pos if r.m else None for r in tk.attach_morphology(t, m).collect()} == {"aa": "noun", "bb": "verb", "cc": None, "dd": None}


def test_alignment_and_votes(spark):
    t = plain(spark, {(1, 1): "aa bb", (1, 2): "cc dd cc"})
    c = spark.createDataFrame([("1:1", 5, "xx"), ("1:1", 6, "yy"), ("1:2", 9, "dd"), ("1:2", 8, "cc")], "pid string, word int, form string")
    assert {(r.pid, r.pos): r.word for r in tk.align_words(t, c).collect()} == {("1:1", 0): 5, ("1:1", 1): 6, ("1:2", 0): 8, ("1:2", 1): 9, ("1:2", 2): 8}
    v = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 3), ("b", "w", 4), ("b", "w", 5)], "k string, v string, at int")
    assert {r.k: (r.v, r.votes) for r in tk.vote(v, "k", "v", ["at"]).collect()} == {"a": ("y", 1), "b": ("w", 2)}
    voted = tk.annotate(t.drop("lemma"), spark.createDataFrame([("aa", "RR")], "norm string, root string"), spark.createDataFrame([("aa", "LL")], "norm string, lemma string"))
    assert {(r.key, r.root, r.lemma) for r in voted.where("key in ('aa', 'bb')").collect()} == {("aa", "aa", "LL"), ("bb", "bb", None)}


def test_roles(spark):
    t = corpus(spark, {(1, 1): [("يا", word("particle")), ("رب", word("noun", case="nom")), ("من", word("particle")), ("بيت", word("noun", case="gen")), ("عظيم", word("noun", case="gen")), ("راي", word("verb")), ("رجلا", word("noun", case="acc")), ("و", word("particle")), ("ولد", word("noun", case="acc"))]})
    roles = [r.role for r in morphology.roles(t).orderBy("pos").collect()]
    assert roles == ["particle", "vocative", "particle", "prepositional", "annexed", "verb", "object", "particle", "conjoined"]
    share = {r.role: r["share"] for r in morphology.role_breakdown(morphology.roles(t)).collect()}
    assert share["particle"] == pytest.approx(3 / 9) and sum(share.values()) == pytest.approx(1)


def test_register_shifts(spark):
    v = lambda person, number="s", aspect="perf": ("x", word("verb", person, number=number, gender="m", aspect=aspect, voice="act"))
    t = corpus(spark, {(1, 1): [v(3)], (1, 2): [("n", word("noun"))], (1, 3): [v(2), v(1)], (1, 4): [v(1, "p")], (1, 5): [v(1, "p", "impf")]})
    got = [(r.a, r.b, r.type, r["from"], r.to) for r in morphology.register_shifts(t).orderBy("a", "type").collect()]
    assert got == [(1, 3, "person", "3", "1"), (3, 4, "number", "s", "p"), (4, 5, "aspect", "perf", "impf")]
    seg = [(r.a, r.b, r.type) for r in morphology.segment_shifts(t).orderBy("a", "type").collect()]
    assert seg[:2] == [(2, 3, "person"), (3, 4, "person")]


def test_rhetoric_and_antithesis(spark):
    t = corpus(spark, {(1, 1): [("والشمس", word("noun")), ("اذا", word("particle"))], (1, 2): [("اقسم", word("verb", root="قسم", vf=4))], (1, 3): [("لو", word("particle")), ("اذا", word("particle"))]})
    assert {(r.pid, r.kind, r.marker) for r in morphology.rhetoric(t).collect()} == {("1:1", "oath", "والشمس"), ("1:1", "conditional", "اذا"), ("1:2", "oath", "اقسم"), ("1:3", "conditional", "لو")}
    t = corpus(spark, {(1, 1): [("لا", word()), ("موت", word(root="موت")), ("بل", word()), ("حياة", word(root="حيي"))], (2, 1): [("حياة", word(root="حيي"))]})
    frames = morphology.antithesis_frames(t).drop("passages")
    assert [(r.a, r.b, r.frames) for r in frames.collect()] == [("حيي", "موت", 1)]
    curated = spark.createDataFrame([("موت", "حيي", "life"), ("a", "b", "x")], "a string, b string, cat string")
    rel = morphology.relations(curated, frames.unionByName(spark.createDataFrame([("p", "q", 2)], "a string, b string, frames long")))
    assert {(r.a, r.b, r.polarity, r.frames) for r in rel.collect()} == {("حيي", "موت", "opposite", 1), ("a", "b", "opposite", 0), ("p", "q", "candidate", 2)}
    assert morphology.relations_of(rel, "موت").first().other == "حيي"
    assert [(r.pid, r.level) for r in morphology.pair_evidence(t, "موت", "حيي").orderBy("level", "pid").collect()] == [("1:1", 1)]


def test_orthography(spark):
    rows = [("1:1", 1, 1, 0, "إِبْرَٰهِۦمَ"), ("1:2", 1, 2, 0, "إِبْرَٰهِۦمَ"), ("2:1", 2, 1, 0, "إِبْرَٰهِيمَ"), ("2:1", 2, 1, 1, "كتب")]
    t = spark.createDataFrame([(*r, None, None) for r in rows], "pid string, grp long, ord long, pos int, orig string, lemma string, root string")
    v = orthography.variants(t).collect()
    assert len(v) == 1 and v[0].total == 3 and v[0].groups == 2 and {f.rasm: f["count"] for f in v[0].forms} == {"ابرهم": 2, "ابرهيم": 1}
    p = {r.rasm: r for r in orthography.profile(t, v[0].id).collect()}
    assert p["ابرهم"].longest_run == 2 and len(p["ابرهيم"].switches) == 1
    assert {r.category for r in orthography.defective(t).collect()} == {"dagger"}
    canon = spark.createDataFrame([("r", "ابرهم", "ابراهيم", None), ("r", "zz", "zz", ["كتب"])], "rule string, form string, modern string, alternates array<string>")
    assert {(r.form, r.found, r.differs) for r in orthography.reconcile(t, canon).collect()} >= {("ابرهم", 2, True)}


def test_search_in_arabic(spark):
    t = tk.arabic_tokens(spark.createDataFrame([("1:1", 1, 1, "مِنْ أَهْلِ ٱلْقُرَىٰ"), ("1:2", 1, 2, "أَهْلُ ٱلْبَيْتِ مِنْ"), ("2:1", 2, 1, "وَٱلْجِنَّ")], "pid string, grp long, ord long, text string"))
    alias = tk.aliases(t.select("orig", "key", F.struct("grp", "ord", "pos").alias("first")))
    got = search.resolve(alias.where("tier = 'strong'"), "جن", tk.document_frequency(t)).first()
    assert (got.key, got.tier) == ("والجن", 3)
    index = search.content_index(t)
    query = spark.createDataFrame([("أهل",), ("القرى",)], "w string").select(arabic.full_text_variants(F.col("w"))).collect()
    found = search.full_text(index, [r[0] for r in query]).collect()
    assert found[0].pid == "1:1" and found[0].run == 2 and found[0].score == 21020
    assert [r.pid for r in search.phrase(t, ["اهل", "البيت"]).collect()] == ["1:2"]
    assert {r.key for r in search.romanised(t.select("key"), "jinn", tk.document_frequency(t)).where("tier = 3").collect()} == {"والجن"}


def test_quotations_across_passages(spark):
    t = plain(spark, {(1, 1): "aa bb", (1, 2): "ccdd ee", (2, 1): "aa bb"}).withColumn("quote_keys", F.array("key"))
    hit = search.locate_across(t, [["bb"], ["cc"], ["dd"], ["ee"]]).collect()
    assert [(r.pid, r.pos) for r in hit] == [("1:1", 1)]
    assert search.locate_across(t, [["bb"], ["aa"]]).count() == 0
    ref = spark.createDataFrame([("2:255",), ("2/3",), ("x",)], "t string").select(search.verse_key(F.col("t")).alias("k")).collect()
    assert [(r.k.grp, r.k.ord) if r.k else None for r in ref] == [(2, 255), (2, 3), None]
    g = spark.createDataFrame([(1, "الفاتحة", "al-Fatiha"), (2, "البقرة", "al-Baqara")], "grp long, name string, latin string")
    assert {r.grp for r in search.group_index(g).where("alias in ('2', 'albaqara')").collect()} == {2}


def test_full_text_relaxes(spark):
    t = plain(spark, {(1, 1): "aa bb zz", (1, 2): "bb aa", (1, 3): "aa cc bb", (1, 4): "cc"})
    index = search.content_index(t, False)
    assert [(r.pid, r.run, r.ordered) for r in search.full_text(index, [["aa"], ["bb"]]).collect()] == [("1:1", 2, True), ("1:3", 1, True), ("1:2", 1, False)]
    assert [r.pid for r in search.full_text(index, [["aa"], ["bb"], ["qq"]]).collect()][:1] == ["1:1"]
    assert [r.pid for r in search.full_text(index, [["zz"], ["qq"]]).collect()] == ["1:1"]
    assert search.full_text(index, [["qq"], ["ww"], ["aa"]]).count() == 0


def test_phrases_and_diffs(spark):
    t = plain(spark, {(1, 1): "aa bb cc dd ee", (1, 2): "xx aa bb cc dd yy", (1, 3): "bb cc dd zz", (2, 1): "aa bb cc dd ee ff"})
    got = {r.phrase: (r.n_words, r.others) for r in similarity.shared_phrases(t, "1:1").collect()}
    assert got == {"aa bb cc dd ee": (5, 1), "aa bb cc dd": (4, 2), "bb cc dd": (3, 3)}
    twins = {(r.a, r.b): (r.same, r.changed) for r in similarity.near_twins(t).collect()}
    assert twins == {("1:1", "2:1"): (5, 1)}
    d = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"])], "a array<string>, b array<string>").select(similarity.word_diff(F.col("a"), F.col("b")).alias("d")).first().d
    assert (d.same, d.changed) == (2, 2) and d.ratio == pytest.approx(2 / 3)


def test_kin_and_seams(spark):
    roots = spark.createDataFrame([("كتب",), ("بتك",), ("كتم",), ("نور",), ("كب",)], "key string")
    assert {(r.key, r.anagram) for r in similarity.kin(roots, "كتب").collect()} == {("بتك", True), ("كتم", False), ("كب", False)}
    t = plain(spark, {(1, 1): "aa", (1, 2): "zz qq", (2, 1): "zz aa", (3, 1): "mm"})
    keys = spark.createDataFrame([(1, "aa"), (2, "aa")], "grp long, key string")
    assert [(r.a, r.b, r.shared_keys, r.seam) for r in similarity.seams(t, keys).collect()] == [(1, 2, "aa", "aa zz")]


def test_graph(spark):
    t = plain(spark, {(1, 1): "aa bb cc", (1, 2): "aa bb", (1, 3): "aa", (1, 4): "bb", (1, 5): "aa cc"})
    nodes, links = graph.expand(t, "1:1", ["aa", "bb"], branch=2)
    got = {r.id: (r.kind, r.parent) for r in nodes.collect()}
    assert got["1:1"] == ("passage", None) and got["1:2"] == ("passage", "aa") and got["more:aa"] == ("more", "aa") and got["1:4"] == ("passage", "bb")
    assert {(r.source, r.target) for r in links.where("kind = 'loop'").collect()} == {("bb", "1:2")}
    tree = links.where("kind = 'tree'")
    assert {r.id for r in graph.descendants(tree, "aa").collect()} == {"1:2", "1:5"}
    assert [r.id for r in graph.path_to(tree, "1:2").orderBy("step").collect()] == ["1:2", "aa", "1:1"]


def test_lexicon(spark):
    roots = spark.createDataFrame([("كتب",), ("مدد",), ("سأل",), ("xyz",)], "root string")
    headers = spark.createDataFrame([("كتب",), ("مد",), ("سال",)], "header string")
    got = {r.root: (r.header, r.tier) for r in lexicon.match_headers(roots, headers).collect()}
    assert got == {"كتب": ("كتب", 0), "مدد": ("مد", 1), "سأل": ("سال", 2), "xyz": (None, None)}
    m = lexicon.match_headers(roots, headers).withColumn("lexicon", F.lit("l"))
    assert lexicon.lexicon_coverage(m).first()["share"] == pytest.approx(0.75)
    e = spark.createDataFrame([("l1", "a", "to write"), ("l2", "a", "writer"), ("l1", "b", "write")], "lexicon string, root string, concise string")
    assert [(r.root, r.lexicons) for r in lexicon.search_glosses(e, "write").collect()] == [("a", 2), ("b", 1)]


def test_typed_letters_and_hashes(spark):
    from corpuslens.functions import typed

    df = spark.createDataFrame([("kt'ab",), ("Hmd",), ("'x",), ("s'ms",), ("Bab",)], "t string")
    assert [r[0] for r in df.select(typed.typed_arabic(F.col("t"))).collect()] == ["كثاب", "حمد", "ء", "شمس", "باب"]

    def fnv(s):
        h = 0x811C9DC5
        for c in s:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return h

    words = ["كتب", "", "abc"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(typed.fnv1a(F.col("w")), typed.shard_of(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(fnv(w), fnv(w) % 64) for w in words]
    f = spark.createDataFrame([(0, 2), (4, 5), (12, 42)], "f int, g int").select(typed.form_roman(F.col("f")), typed.opening_letters(F.col("g"))).collect()
    assert [r[0] for r in f] == ["", "IV", "12"] and [r[1] for r in f] == [["ا", "ل", "م"], None, ["ح", "م", "ع", "س", "ق"]]
    assert spark.range(1).select(typed.taa_variants(F.array(F.lit("رحمة"), F.lit("بيت"), F.lit("x")))).first()[0] == ["رحمه", "بيه"]
    assert spark.range(1).select(typed.state(q=F.lit("x"), n=F.lit(None).cast("int"))).first()[0] == '{"q":"x"}'


def test_shared_phrases_by_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcd", k=rng.randrange(3, 14))) for _ in range(30)]
    t = plain(spark, {(1, i): x for i, x in enumerate(texts)})
    pad = lambda x: f" {x} "
    for k in (0, 7):
        ws = texts[k].split()
        runs = {" ".join(ws[i:j]) for i in range(len(ws)) for j in range(i + 3, len(ws) + 1)}
        n = {r: sum(pad(r) in pad(x) for i, x in enumerate(texts) if i != k) for r in runs}
        n = {r: c for r, c in n.items() if c}
        want = {r: c for r, c in n.items() if not any(len(q) > len(r) and d >= c and pad(r) in pad(q) for q, d in n.items())}
        assert {r.phrase: r.others for r in similarity.shared_phrases(t, f"1:{k}").collect()} == want
