"""Typed Latin letters as Arabic, shards by hash, and short displays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each typed character stands for, and what an apostrophe makes of the letter before it.
TYPED = {
    "a": "ا", "b": "ب", "t": "ت", "j": "ج", "H": "ح", "d": "د", "r": "ر", "z": "ز", "s": "س", "S": "ص", "D": "ض", "T": "ط", "Z": "ظ", "e": "ع",
    "g": "غ", "f": "ف", "q": "ق", "k": "ك", "l": "ل", "m": "م", "n": "ن", "h": "ه", "w": "و", "y": "ي", "-": "ء", "|": "آ", "<": "إ", "p": "ة", "Y": "ى",
    "0": "٠", "1": "١", "2": "٢", "3": "٣", "4": "٤", "5": "٥", "6": "٦", "7": "٧", "8": "٨", "9": "٩", ",": "،", ";": "؛", "?": "؟", "%": "٪",
}
UPGRADED = {"ت": "ث", "د": "ذ", "ح": "خ", "س": "ش", "ا": "أ", "و": "ؤ", "ي": "ئ"}
FORMS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI")
#: Groups that open with disjoined letters, and those letters.
OPENINGS = {
    2: "الم", 3: "الم", 7: "المص", 10: "الر", 11: "الر", 12: "الر", 13: "المر", 14: "الر", 15: "الر", 19: "كهيعص", 20: "طه", 26: "طسم", 27: "طس", 28: "طسم", 29: "الم", 30: "الم",
    31: "الم", 32: "الم", 36: "يس", 38: "ص", 40: "حم", 41: "حم", 42: "حمعسق", 43: "حم", 44: "حم", 45: "حم", 46: "حم", 50: "ق", 68: "ن",
}


def typed_arabic(text: Column) -> Column:
    """What a typed Latin string means in Arabic letters; a capital without a meaning of its own is its small letter, other Latin letters are nothing, an apostrophe upgrades the letter before it or stands for hamza."""
    capitals = "".join(chr(c).upper() for c in range(ord("a"), ord("z") + 1) if chr(c).upper() not in TYPED and chr(c) in TYPED)
    s = F.translate(text, capitals, capitals.lower())
    s = F.translate(s, "".join(TYPED), "".join(TYPED.values()))
    s = F.regexp_replace(s, "[A-Za-z]", "")
    for plain, upgraded in UPGRADED.items():
        s = F.regexp_replace(s, plain + "'", upgraded)
    return F.regexp_replace(F.regexp_replace(s, "غ'", "غ"), "'", "ء")


def fnv1a(text: Column) -> Column:
    """The unsigned 32-bit FNV-1a hash of the characters, for files that were dealt out by it."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def shard_of(text: Column, shards: int = 64) -> Column:
    return (fnv1a(text) % shards).cast("int")


def form_roman(form: Column) -> Column:
    return F.when(form.between(1, len(FORMS)), F.try_element_at(F.array(*map(F.lit, FORMS)), form.cast("int"))).when(form > 0, form.cast("string")).otherwise("")


def opening_letters(group: Column) -> Column:
    """The distinct letters that a group opens with, or null."""
    known = F.create_map(*[F.lit(x) for kv in OPENINGS.items() for x in kv])
    return F.array_distinct(F.filter(F.split(F.try_element_at(known, group.cast("int")), ""), lambda c: c != ""))


def taa_variants(keys: Column) -> Column:
    """The keys that end in either taa, with h for it."""
    return F.transform(F.filter(keys, lambda k: k.rlike("[ةت]$")), lambda k: F.regexp_replace(k, "[ةت]$", "ه"))


def state(**values: Column) -> Column:
    """Query parameters as compact JSON, those that are null left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))
