"""Keys of Arabic words."""

from pyspark.sql import functions as F

from corpuslens.functions import arabic


def one(spark, f, *words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    return [r[0] for r in df.select(f(F.col("w")).alias("x")).collect()]


def test_norm(spark):
    assert one(spark, arabic.norm, "ٱلرَّحْمَٰنِ", "إِيَّاكَ", "مُوسَىٰ", "رَحْمَةٍ", "یک", None, "abc") == ["الرحمن", "اياك", "موسي", "رحمه", "يك", "", ""]
    assert one(spark, arabic.norm_strict, "رَحْمَةٍ", "مُوسَىٰ") == ["رحمة", "موسى"]
    assert one(spark, arabic.norm, "ﻻ", "ﷲ", "ﻣﻦ") == ["لا", "الله", "من"]


def test_forgiving_keys(spark):
    assert one(spark, arabic.search_alef, "ٱلسَّلَٰم", "ٱلصَّلَوٰة") == ["السلام", "الصلاه"]
    keys = one(spark, arabic.strong_keys, "جِئْنَا")[0]
    assert "جينا" in keys and "جءنا" in keys
    assert one(spark, arabic.fuzzy_keys, "جِئْنَا") == [["جنا"]]
    assert one(spark, arabic.geminate_out, "ٱلَّيْل") == ["ٱلَلَيْل"] or "لل" in one(spark, lambda c: arabic.norm(arabic.geminate_out(c)), "ٱلَّيْل")[0]
    assert set(one(spark, arabic.quote_keys, "ٱلَّيْل")[0]) >= {"اليل", "الليل"}
    assert all(len(k) >= 2 for k in one(spark, arabic.quote_keys, "ٱلرِّبَوٰا")[0])


def test_stems(spark):
    assert set(one(spark, arabic.de_affix, "والجن")[0]) == {"الجن", "جن"}
    assert one(spark, arabic.de_affix, "الجن", "جن", "من") == [["جن"], [], []]
    assert len(one(spark, arabic.de_affix, "وبكلسف")[0]) == 3


def test_full_text_keys(spark):
    a, b = (set(x) for x in one(spark, arabic.full_text_variants, "ءَاتَىٰكُمُ", "آتاكم"))
    assert a & b
    a, b = (set(x) for x in one(spark, arabic.full_text_variants, "ٱلرِّبَوٰا۟", "الربا"))
    assert a & b


def test_rasm_and_reading(spark):
    short, full = "إِبْرَٰهِۦمَ", "إِبْرَٰهِيمَ"
    assert one(spark, arabic.rasm_key, short, full) == ["ابرهم", "ابرهيم"]
    assert len(set(one(spark, arabic.pron_key, short, full))) == 1
    assert len(set(one(spark, arabic.pron_key, "صَلَوٰة", "صلاة"))) == 1


def test_endings(spark):
    texts = ["x ٱلْعَٰلَمِينَ", "ٱلرَّحِيمِ", "ٱلْهُدَىٰ", "ضُحَىٰهَا", "", None]
    assert one(spark, arabic.rhyme_key, *texts) == ["ين", "يم", "ا", "ها", None, None]
    assert one(spark, arabic.rawiy_key, *texts)[:4] == ["ن", "م", "ا", "ه"]
    p = one(spark, arabic.final_prosody, "ٱلرَّحِيمِ", "")
    assert p[0].cv == "VCCCVC" and p[0].radf and not p[0].tasis and p[1] is None
    assert one(spark, arabic.place_of, "ب", "م", "ق", "x") == [7, 7, 1, -1]


def test_roots_and_latin(spark):
    assert one(spark, arabic.collapse_geminate, "مدد", "كتب") == ["مد", "كتب"]
    assert one(spark, arabic.match_norm, "سأل", "دعو") == ["سال", "دعى"]
    assert one(spark, arabic.spaced_root, "باب (ك ت ب) ms12", "none") == ["كتب", None]
    assert one(spark, arabic.latin_skeleton, "shaytan", "Jibril", "yusuf", "Rahman", "cap", "Musaa", "al-baqara", "vizier", "nuuh", "'isa") == ["sytn", "jbrl", "ysf", "rhmn", "kb", "ms", "lbkr", "fzr", "nh", "s"]
    assert one(spark, arabic.arabic_skeleton, "شيطن", "جبريل", "يوسف", "وجد", "غفور", "البقره") == ["stn", "jbrl", "ysf", "wjd", "gfr", "lbkrh"]
    assert one(spark, arabic.is_latin, "abc", "كتب") == [True, False]


def test_tags(spark):
    df = spark.createDataFrame([("ROOT:qwl|LEM:qaAla|VF:1|PERF|3MP", "V"), ("PN|GEN|FS", "N"), ("PREF", "P"), ("IMPF|PASS|MOOD:JUS|2D", "V")], "f string, c string")
    m = [r[0] for r in df.select(arabic.parse_tags(F.col("f"), F.col("c"))).collect()]
    assert (m[0].root, m[0].vf, m[0].aspect, m[0].voice, m[0].pos, m[0].person, m[0].gender, m[0].number) == ("qwl", 1, "perf", "act", "verb", 3, "m", "p")
    assert (m[1].pos, m[1].gcase, m[1].gender, m[1].number, m[1].person, m[1].voice) == ("pn", "gen", "f", "s", 0, None)
    assert m[2].pref and m[2].pos == "particle" and (m[3].voice, m[3].mood, m[3].person, m[3].number) == ("pass", "jus", 2, "d")
