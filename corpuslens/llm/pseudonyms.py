"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

A value that passes its format's check is taken as a number below a*b and goes through a keyed Feistel network of two
halves, one below a and one below b, so each key permutes the values of a format. Equal values get equal pseudonyms in
all documents, and different values different ones. Where the check leaves out some numbers, the network is walked until
a valid one comes up, which keeps it a permutation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Fixed patterns of what may be personal, by kind, in order of precedence; what they find is then checked.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
_ALL = "|".join(PATTERNS.values())
#: First day, number of days and halves of the two date domains: 1900 to 2099, and all other days of the years 1 to 9999.
_NEAR = ("1900-01-01", 73_049, 271, 270)
_FAR = ("0001-01-01", 3_652_059, 1912, 1912)
_NEAR_FROM = 693_595  # 1900-01-01 in days after 0001-01-01


def _long(x: int | Column) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def _keyed(key: str, tag: Column, turn: Column, half: Column) -> Column:
    """60 bits of a keyed digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, turn.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def permute(x: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """The keyed permutation of the numbers below a*b."""

    def turn(pair: Column, i: Column) -> Column:
        left = F.struct(((pair["l"] + _keyed(key, tag, i, pair["r"])) % a).alias("l"), pair["r"].alias("r"))
        right = F.struct(pair["l"].alias("l"), ((pair["r"] + _keyed(key, tag, i, pair["l"])) % b).alias("r"))
        return F.when(i % 2 == 1, left).otherwise(right)

    start = F.struct(F.call_function("div", x, b).cast("long").alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda p: p["l"] * b + p["r"])


def _walk(x: Column, once: Callable[[Column], Column], valid: Callable[[Column], Column], most: int) -> Column:
    """once(x), and again until it is valid. An invalid value after ``most`` more steps has a chance below 1 in 10^12."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), once(x), lambda v, _: F.when(valid(v), v).otherwise(once(v)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """The permutation of the digit strings of one length, 18 at most."""
    n = F.length(digits)
    half = F.floor(n / 2)
    power = lambda e: F.pow(F.lit(10.0), e).cast("long")
    new = permute(digits.cast("long"), power(half), power(n - half), key, F.concat(F.lit(tag), n.cast("string")))
    return F.lpad(new.cast("string"), n, "0")


def _luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload a valid number."""
    n = F.length(payload)
    digit = lambda i: F.substring(payload, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    added = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 0, doubled(i)).otherwise(digit(i)))
    return ((10 - added % 10) % 10).cast("string")


def _refill(old: Column, digits: Column) -> Column:
    """old with its digits replaced by those given, one after another."""

    def place(i: Column) -> Column:
        c = F.substring(old, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(old, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(old)), place), "")


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    payload = F.substring(d, F.lit(1), F.length(d) - 1)
    valid = (_luhn_digit(payload) == F.right(d, F.lit(1))) & ~d.rlike(r"^(\d)\1*$")
    new = permute_digits(payload, key, "card")
    return F.when(valid, _refill(m, F.concat(new, _luhn_digit(new))))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    return _refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), permute_digits(F.right(d, F.lit(10)), key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    valid = lambda d: ~(d.rlike(r"^(000|666|9)") | d.rlike(r"^...00") | d.rlike(r"0000$"))
    d = _digits(m)
    return F.when(valid(d), _refill(m, _walk(d, lambda x: permute_digits(x, key, "ssn"), valid, 16)))


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    octet = lambda i: F.element_at(parts, i + 1).cast("int")
    number = F.aggregate(F.sequence(F.lit(0), F.lit(3)), _long(0), lambda s, i: s * 256 + octet(i))
    new = permute(number, _long(65536), _long(65536), key, F.lit("ip"))
    out = F.concat_ws(".", *[(F.shiftright(new, 24 - 8 * i) % 256).cast("string") for i in range(4)])
    return F.when(F.forall(F.transform(parts, lambda p: p.cast("int")), lambda p: p < 256), out)


def _date(m: Column, key: str) -> Column:
    """The order of day and month in a date with slashes is the day first where that is a date, else the month."""
    iso = m.contains("-")
    form = F.when(iso, "yyyy-MM-dd").when(F.try_to_date(m, "dd/MM/yyyy").isNotNull(), "dd/MM/yyyy").otherwise("MM/dd/yyyy")
    date = F.coalesce(*[F.when(form == f, F.try_to_date(m, f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")])
    n = F.datediff(date, F.to_date(F.lit(_FAR[0]))).cast("long")
    near = (n >= _NEAR_FROM) & (n < _NEAR_FROM + _NEAR[1])
    step = lambda domain, tag: lambda x: permute(x, _long(domain[2]), _long(domain[3]), key, F.lit(tag))
    outside = lambda x: (x < _FAR[1]) & ~((x >= _NEAR_FROM) & (x < _NEAR_FROM + _NEAR[1]))
    new = F.when(near, _walk(n - _NEAR_FROM, step(_NEAR, "near"), lambda x: x < _NEAR[1], 6) + _NEAR_FROM).otherwise(_walk(n, step(_FAR, "far"), outside, 9))
    day = F.date_add(F.to_date(F.lit(_FAR[0])), new.cast("int"))
    return F.when((n >= 0) & (n < _FAR[1]), F.coalesce(*[F.when(form == f, F.date_format(day, f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")]))


def _email(m: Column, key: str) -> Column:
    """An address is no number: its name gets letters of a keyed digest of the whole; the domain stays."""
    name = F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), "0123456789", "ghijklmnop")
    return F.concat(name, F.substring(m, F.locate("@", m), F.length(m)))


_NEW = {"email": _email, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the text with pseudonyms, n_found and found (kind, and the number of each kind) of each row of docs.

    Card numbers (Luhn), dates (calendar, years 1 to 9999), social security numbers (issued ranges), IPv4 addresses and
    phone numbers that pass their check are permuted within their format, separators and country codes staying; names in
    e-mail addresses are replaced by a keyed digest. What fails its check stays as it is. A null text stays null with
    n_found 0. The whole text is searched; rows don't meet, so there is no shuffle.
    """
    text = F.col("__text")
    whole = lambda p: "^(?:" + p + ")$"
    kind = lambda m: F.coalesce(*[F.when(m.rlike(whole(p)), F.lit(k)) for k, p in PATTERNS.items()])
    new = lambda m, k: F.coalesce(*[F.when(k == name, make(m, key)) for name, make in _NEW.items()])
    found = F.transform(F.regexp_extract_all(text, F.lit(_ALL), F.lit(0)), lambda m: F.struct(m.alias("old"), kind(m).alias("kind")))
    found = F.transform(found, lambda f: F.struct(f["old"], f["kind"], new(f["old"], f["kind"]).alias("new")))
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    marked = base.select("__id", "__text", F.when(text.rlike("[0-9@]"), found).alias("__found"))
    pieces = F.zip_with(F.split(text, _ALL), "__found", lambda s, f: F.concat(F.coalesce(s, F.lit("")), F.coalesce(f["new"], f["old"], F.lit(""))))
    done = F.filter(F.coalesce("__found", F.array()), lambda f: f["new"].isNotNull())

    def count(kind: str) -> Column:
        n = F.size(F.filter(done, lambda f: f["kind"] == kind))
        return F.when(n > 0, F.struct(F.lit(kind).alias("kind"), n.alias("n")))

    counts = F.array_compact(F.array(*map(count, PATTERNS)))
    return marked.select(
        F.col("__id").alias(id_col),
        F.when(F.size("__found") > 0, F.array_join(pieces, "")).otherwise(text).alias("text"),
        F.when(F.size("__found") > 0, F.size(done)).otherwise(0).alias("n_found"),
        F.when(F.size("__found") > 0, counts).otherwise(F.slice(counts, 1, 0)).alias("found"))
