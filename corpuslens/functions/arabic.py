"""Normal forms and matching keys of Arabic words, as column expressions on Spark strings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and marks that the keys are defined by.
ALIFS, HAMZAS = "ٱآأإ", "ءئؤ"
MARKS = "[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭ࣓-ࣿ]"
DAGGER, TATWEEL, SHADDA = "ٰ", "ـ", "ّ"
LOOKALIKES = ("یۍېےکڪگڭھہۀ", "ييييككككههه")
PROCLITICS = "وفبكلس"
MADD = "اوي"
#: Places of articulation, by group.
PLACES = ("ءهعحغخ", "قك", "جشي", "ضلنر", "طدت", "صزس", "ظذث", "فبمو", "ا")
NAME_VARIANTS = {"ميكاييل": "ميكال", "ميكايل": "ميكال", "جبراييل": "جبريل", "جبرييل": "جبريل", "غابرييل": "جبريل", "داوود": "داود"}


def _presentation_forms() -> tuple[str, str]:
    """The Arabic presentation forms of one letter, and the letters."""
    forms = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for a, b in ((0xFB50, 0xFDFF), (0xFE70, 0xFEFD)) for c in range(a, b)]
    return tuple("".join(x) for x in zip(*((f, n) for f, n in forms if len(n) == 1 and n != f), strict=True))


FORMS = _presentation_forms()


def norm(word: Column, fold: bool = True) -> Column:
    """Letters only: presentation forms are letters (of the joined ones lam-alif and the name of God), marks and tatweel go, alifs become one; with ``fold`` also final taa and maqsura and the hamza seats."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(word, F.lit("")), "[ﻵ-ﻼ]", "لا"), "ﷲ", "الله")
    s = F.translate(s, FORMS[0] + LOOKALIKES[0], FORMS[1] + LOOKALIKES[1])
    s = F.translate(F.regexp_replace(s, MARKS + "|" + TATWEEL, ""), LOOKALIKES[0] + ALIFS, LOOKALIKES[1] + "ا" * len(ALIFS))
    if fold:
        s = F.translate(s, "ةىؤئ", "هيوي")
    return F.regexp_replace(s, "[^ء-ي]", "")


def norm_strict(word: Column) -> Column:
    return norm(word, fold=False)


def search_alef(word: Column) -> Column:
    """The norm with every long a that is only marked written as an alif."""
    s = F.regexp_replace(F.coalesce(word, F.lit("")), "[وى]" + DAGGER, "ا")
    return F.regexp_replace(norm(F.regexp_replace(s, DAGGER, "ا")), "ا{2,}", "ا")


def _keys(*keys: Column, least: int = 2) -> Column:
    return F.filter(F.array_distinct(F.array(*keys)), lambda k: F.length(k) >= least)


def strong_keys(word: Column) -> Column:
    return _keys(norm(word), search_alef(word), search_alef(F.translate(word, "ؤئ", "ءء")))


def loose_keys(word: Column) -> Column:
    return _keys(norm(word), search_alef(word), search_alef(F.regexp_replace(word, f"[{HAMZAS}]", "")))


def fuzzy_keys(word: Column) -> Column:
    return F.array_except(loose_keys(word), strong_keys(word))


def geminate_out(word: Column) -> Column:
    """A doubled letter written twice."""
    return F.regexp_replace(word, "([ء-ي])([ً-ِْ-ٰ]*)" + SHADDA, "$1$1$2")


def quote_keys(word: Column) -> Column:
    """All keys under which a quoted word may equal a word of the text: two are equal if the arrays overlap."""
    blind = norm(F.regexp_replace(word, "[ءئؤأإآ]", ""))
    seat = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[وى]" + DAGGER, "ا"), DAGGER, "ا"), "ى", "ا")
    more = F.array(
        F.when(F.length(blind) >= 3, blind), F.when(word.rlike("وا$"), norm(F.regexp_replace(word, "وا$", "و"))),
        F.regexp_replace(norm(seat), "ا{2,}", "ا"))
    doubled = F.when(geminate_out(word) != word, strong_keys(geminate_out(word))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(strong_keys(word), fuzzy_keys(word), doubled, more)), lambda k: k.isNotNull() & (F.length(k) >= 2))


def rasm_key(word: Column) -> Column:
    """The skeleton as drawn."""
    return norm_strict(word)


def pron_key(word: Column) -> Column:
    """The skeleton as read: marks that stand for a long vowel are letters, a final open taa is a closed one."""
    v = "[ً-ٟ]*"
    s = F.coalesce(word, F.lit(""))
    for pattern, to in (("و" + v + DAGGER + "(" + v + "ة)", "ا$1"), ("و" + v + DAGGER + "(" + v + "ا۟?)", "ا"), ("ى" + v + DAGGER, "ا"), (DAGGER, "ا"), ("ت([ً-ّ]*)$", "ة$1")):
        s = F.regexp_replace(s, pattern, to)
    return norm(F.translate(s, "ۥۦ", "وي"))


def de_affix(key: Column) -> Column:
    """Stems of a key: one to three leading proclitics peeled, and the article; of two letters at least."""
    article = lambda x: F.when(x.startswith("ال") & (F.length(x) >= 4), F.substring(x, F.lit(3), F.length(x)))
    out = []
    for n in (1, 2, 3):
        goes, stem = (F.length(key) > n + 1) & key.rlike(f"^[{PROCLITICS}]{{{n}}}"), F.substring(key, F.lit(n + 1), F.length(key))
        out += [F.when(goes, stem), F.when(goes, article(stem))]
    return F.array_distinct(F.array_compact(F.array(*out, article(key))))


def full_text_keys(word: Column) -> Column:
    """The variants under which full-text search finds a word, without its stems."""
    seat = F.regexp_replace(F.regexp_replace(word, "[وى]" + DAGGER, "ا"), DAGGER, "ا")
    one = lambda x: F.regexp_replace(norm(x), "ا{2,}", "ا")
    base = F.array(norm(word), one(seat), one(F.regexp_replace(seat, "ى", "ا")), one(geminate_out(seat)))
    both = F.concat(base, F.transform(base, lambda k: F.regexp_replace(k, "ء", "")))
    return F.filter(F.array_distinct(both), lambda k: F.length(k) >= 2)


def full_text_variants(word: Column) -> Column:
    keys = full_text_keys(word)
    return F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, de_affix))))


# --- verse endings ------------------------------------------------------------------------------------------------------


def pausal(word: Column) -> Column:
    """The skeleton of a word in pause: final taa is h, maqsura stays."""
    s = F.translate(F.regexp_replace(F.coalesce(word, F.lit("")), MARKS + "|" + TATWEEL, ""), ALIFS + "ةؤئ", "اااا" + "هوي")
    return F.regexp_replace(s, "[^ء-ي]", "")


def final_skeleton(text: Column) -> Column:
    """The pausal skeleton of the last word that has one; empty if none has."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), pausal), lambda s: s != ""), F.lit(-1)), F.lit(""))


def rhyme_key(text: Column) -> Column:
    """The strict ending of a text: its last consonant with a long vowel before it, or the open syllable it ends in."""
    s = final_skeleton(text)
    last, before = F.right(s, F.lit(1)), F.when(F.length(s) > 1, F.substring(s, F.length(s) - 1, F.lit(1))).otherwise("")
    consonant = (before != "") & ~before.rlike(f"[{MADD}ى]")
    return F.when(s == "", None).when(last == "ى", "ا").when(last.rlike(f"[{MADD}]"), F.when(consonant, F.concat(before, last)).otherwise(last)).otherwise(
        F.concat(F.when(before.rlike(f"[{MADD}]"), before).when(before == "ى", "ا").otherwise(""), last))


def rawiy_key(text: Column) -> Column:
    """The rhyme consonant: the last letter once long vowels after it are dropped."""
    s = final_skeleton(text)
    r = F.right(F.regexp_replace(s, f"(?<=.)[{MADD}]+$", ""), F.lit(1))
    return F.when(s == "", None).when(s.endswith("ى") | (r == "ى"), "ا").otherwise(r)


def place_of(letter: Column) -> Column:
    """The number of the letter's place of articulation, -1 if it has none."""
    return F.coalesce(*[F.when(letter.isin(*group), F.lit(i)) for i, group in enumerate(PLACES)], F.lit(-1))


def final_prosody(text: Column) -> Column:
    """cv (consonants and long vowels), radf (long vowel before the last consonant) and tasis (alif two before it); null for no word."""
    s, long_ = final_skeleton(text), "[اويى]"
    end = lambda n: F.when(F.length(s) >= n, F.substring(s, F.length(s) - n + 1, F.lit(1))).otherwise("")
    closed = ~end(1).rlike(long_)
    cv = F.regexp_replace(F.regexp_replace(s, f"[^{long_[1:-1]}]", "C"), long_, "V")
    return F.when(s != "", F.struct(cv.alias("cv"), (end(2).rlike(long_) & closed).alias("radf"), ((end(3) == "ا") & ~end(2).rlike(long_) & (end(2) != "") & closed).alias("tasis")))


# --- roots ---------------------------------------------------------------------------------------------------------------


def collapse_geminate(root: Column) -> Column:
    """A root whose second and third letters are the same, with one of them."""
    return F.regexp_replace(root, "^(.)(.)\\2$", "$1$2")


def match_norm(root: Column) -> Column:
    """The form in which roots and dictionary headers are compared: hamzas and alifs are one, so are weak endings."""
    return F.regexp_replace(F.regexp_replace(F.translate(root, "ٱأإآءؤئ", "ا" * 7), TATWEEL, ""), "[ويى]$", "ى")


def spaced_root(text: Column) -> Column:
    """The root spelt letter by letter between brackets, or null."""
    clean = F.regexp_replace(text, r"\bms\d+\b|PageV\d+P\d+", " ")
    root = F.regexp_replace(F.regexp_extract(clean, "[(\\[]\\s*([ء-ي](?:\\s+[ء-ي]){1,5})\\s*[)\\]]", 1), r"\s+", "")
    return F.when(root != "", root)


# --- Latin script --------------------------------------------------------------------------------------------------------

# Arabic letters and the Latin consonant that stands for each in a skeleton.
ROMAN = ("بتثجحخدذرزسشصضطظغفقكلمنهة", "bttjhkddrzsssdtzgfkklmnhh")
# What people type for one consonant or a long vowel, in this order.
DIGRAPHS = (("th", "t"), ("dh", "d"), ("kh", "k"), ("sh", "s"), ("gh", "g"), ("ph", "f"), ("ck", "k"), ("ch", "s"), ("ee", "y"), ("oo", "w"), ("ou", "w"), ("ai", "y"), ("au", "w"))


def _once(s: Column) -> Column:
    return F.regexp_replace(s, r"(.)\1+", "$1")


def arabic_skeleton(key: Column) -> Column:
    """A Latin consonant skeleton of an Arabic key: the first letter may be waw or yaa, else weak letters and hamza have none; repeats are one."""
    initial = F.translate(F.regexp_extract(key, "^[وي]", 0), "وي", "wy")
    return _once(F.concat(initial, F.translate(F.regexp_replace(key, f"[^{ROMAN[0]}]", ""), *ROMAN)))


def latin_skeleton(query: Column) -> Column:
    """The same skeleton of a romanised word: digraphs are one letter, short vowels go, c, q and x are k, p is b, v is f."""
    s = F.regexp_replace(F.lower(query), "['`’ʾʿ-]", "")
    for pattern, to in DIGRAPHS:
        s = F.replace(s, F.lit(pattern), F.lit(to))
    return _once(F.translate(F.regexp_replace(s, "[^a-z]|[aeiou]", ""), "cqxpv", "kkkbf"))


def is_latin(query: Column) -> Column:
    return query.rlike("[A-Za-z]") & ~query.rlike("[؀-ۿ]")


# --- morphology tags -----------------------------------------------------------------------------------------------------


def parse_tags(features: Column, word_class: Column) -> Column:
    """The fields of a segment's pipe-separated tags and its class (N, V or P)."""
    tags = F.split(F.coalesce(features, F.lit("")), r"\|")
    has = lambda t: F.array_contains(tags, t)
    value = lambda name: F.try_element_at(F.transform(F.filter(tags, lambda t: t.startswith(name + ":")), lambda t: F.substring(t, F.lit(len(name) + 2), F.length(t))), F.lit(1))
    first = lambda pairs: F.coalesce(*[F.when(c, F.lit(v)) for c, v in pairs])
    aspect = first([(has(t), t.lower()) for t in ("PERF", "IMPF", "IMPV")])
    agree = F.try_element_at(F.filter(tags, lambda t: t.rlike("^([123][MF]?[SDP]?|[MF][SDP]?)$")), F.lit(1))
    part = lambda p: F.when(F.regexp_extract(agree, p, 0) != "", F.lower(F.regexp_extract(agree, p, 0)))
    pos = first([(has("PASS_PCPL"), "passpcpl"), (has("ACT_PCPL"), "actpcpl"), (has("PN"), "pn"), (has("PRON"), "pron"), (has("ADJ"), "adj"), (word_class == "V", "verb"), (word_class == "P", "particle"), (word_class == "N", "noun")])
    return F.struct(
        value("ROOT").alias("root"), value("LEM").alias("lemma"), F.coalesce(value("VF").cast("int"), F.lit(0)).alias("vf"), aspect.alias("aspect"),
        F.when(has("PASS"), "pass").when((word_class == "V") | aspect.isNotNull(), "act").alias("voice"), F.lower(value("MOOD")).alias("mood"), pos.alias("pos"),
        F.coalesce(part("[123]").cast("int"), F.lit(0)).alias("person"), part("[MF]").alias("gender"), part("[SDP]$").alias("number"),
        first([(has("NOM"), "nom"), (has("ACC"), "acc"), (has("GEN"), "gen")]).alias("gcase"), has("PREF").alias("pref"), has("SUFF").alias("suff"))
