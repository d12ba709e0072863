"""Format-preserving pseudonyms for personal data, as DataFrame expressions only.

Numbers and dates that pass their own validation are permuted by a keyed
Feistel network inside the set of valid values of their format: a card number
stays a card number with a right check digit, an address a dotted quad, a date a
date.  A permutation has no collisions, so equal values stay linked across
documents and different values stay apart.  Mail addresses and secrets are not
numbers; they become keyed digests in the shape of the original.

Formats: cards (13 to 19 digits, Luhn), IBANs (mod 97), telephone numbers (North
American, or + and 8 to 15 digits), social security numbers (area, group and
serial in range), IPv4 addresses, dates (ISO, day.month.year, month/day/year, of
1900 to 2099, that exist), mail addresses, access keys, and what follows
``password=``, ``token =`` and the like.  A candidate that fails its validation
stays as it is, so a pseudonym never meets an invalid original.  A North American
number is its ten digits, however it is written; letters of an account become
letters.

Everything happens inside a row: no shuffle, no Python.  A text without a digit,
``@``, ``=``, ``:`` or the beginning of an access key holds none of the shapes and
is not searched.

Cases: a null text stays null and counts nothing; an empty text stays empty; a
very long text is searched whole; repeated rows each get the same pseudonyms; an
empty table gives no rows; of shapes that begin at one place the first in
``SHAPES`` counts; columns other than the text pass through, whatever their names
(inner columns live in one struct).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8

# The shapes, tried in this order at each place of a text.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|secret|token|api[_-]?key))[\"']?\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_.-]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iso_date": r"(?<![\d-])(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "dot_date": r"(?<![\d.])(?:0[1-9]|[12]\d|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)\d{2}(?![\d]|\.\d)",
    "slash_date": r"(?<![\d/])(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d{2}(?![\d/])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "card": r"(?<![\d.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "phone": r"(?<![\d+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}|\+\d{1,3}(?:[ .()/-]{0,2}\d){7,12}+)(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in SHAPES.values())

# What every shape has somewhere: a text without it is not searched.
GATE = "[0-9@=:]|A[KS]IA"

#: The setting that holds the key.
KEY_CONF = "spark.clausework.pii.key"
_RANDOM_KEY = secrets.token_hex(16)


def key_of(spark: SparkSession) -> str:
    """The key of the session's setting.  Without one, a random key of this driver's run: pseudonyms still link
    across all documents of the run, and nobody can turn them back."""
    return spark.conf.get(KEY_CONF, _RANDOM_KEY)


def _hash(key: str, tweak: str, *parts: Column) -> Column:
    """52 bits of a keyed SHA-256."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(tweak), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: str) -> Column:
    """Permute pairs of 0..a-1 and 0..b-1: each round shifts one half by a keyed hash of the other."""

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        return F.when(
            i % 2 == 0, F.struct(((l + _hash(key, tweak, i, b, r) % a) % a).alias("l"), r.alias("r"))
        ).otherwise(F.struct(l.alias("l"), ((r + _hash(key, tweak, i, a, l) % b) % b).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A digit string of 2 to 36 digits becomes another of the same length."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(F.substring(digits, F.lit(1), h), F.substr(digits, h + 1), ten(h), ten(n - h), key, tweak)
    return F.concat(F.lpad(out["l"].cast("string"), h, "0"), F.lpad(out["r"].cast("string"), n - h, "0"))


def permute_letters(letters: Column, key: str, tweak: str) -> Column:
    """A string of up to 36 letters A to Z becomes another of the same length, twelve at a time."""

    def block(k: Column) -> Column:
        part = F.substr(letters, k * 12 + 1, F.lit(12))
        n = F.length(part)
        h = F.floor(n / 2).cast("int")
        size = lambda i: F.pow(F.lit(26.0), i).cast("long")
        number = lambda x: F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda v, c: v * 26 + F.ascii(c) - 65)
        written = lambda v, m: F.transform(F.sequence(m - 1, F.lit(0), F.lit(-1)), lambda i: F.char((F.floor(v / size(i)) % 26 + 65).cast("long")))
        out = feistel(number(F.substring(part, F.lit(1), h)), number(F.substr(part, h + 1)), size(h), size(n - h), key, tweak)
        right = F.array_join(written(out["r"], n - h), "")
        return F.when(n == 0, "").when(h == 0, right).otherwise(F.concat(F.array_join(written(out["l"], h), ""), right))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), block), "")


def _refill(shape: Column, new: Column, kind: str = "0-9") -> Column:
    """The digits (or characters of another ``kind``) of ``shape`` replaced, in order, by ``new``; what stands between stays."""
    at = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{kind}]", ""))
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(f"[{kind}]"), F.substring(new, at(i), F.lit(1))).otherwise(c)), "")


def _digit_array(digits: Column) -> Column:
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))


def _luhn_sum(body: Column) -> Column:
    """Luhn's sum of the digits before the check digit."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(
        F.transform(F.reverse(_digit_array(body)), lambda d, i: F.when(i % 2 == 0, doubled(d)).otherwise(d)), F.lit(0), lambda s, d: s + d
    )


def _check_digit(body: Column) -> Column:
    return ((10 - _luhn_sum(body) % 10) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    new = permute_digits(body, key, "card")
    return F.when(_check_digit(body) == F.right(d, F.lit(1)), _refill(m, F.concat(new, _check_digit(new)))).otherwise(m)


def _mod97(country: Column, check: Column, bban: Column) -> Column:
    """Remainder of the rearranged account number; letters count as 10 to 35."""
    chars = F.filter(F.split(F.concat(bban, country, check), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + value(c)).otherwise(s * 100 + value(c)) % 97
    return F.aggregate(chars, F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    """Digits and letters of the account part are permuted, each among themselves, and the two check digits made anew."""
    flat = F.regexp_replace(m, " ", "")
    country, check, bban = F.substring(flat, 1, 2), F.substring(flat, 3, 2), F.substr(flat, F.lit(5))
    digits_new = _refill(bban, permute_digits(_digits(bban), key, "iban"))
    new = _refill(digits_new, permute_letters(F.regexp_replace(bban, "[^A-Z]", ""), key, "iban letters"), "A-Z")
    checked = F.lpad((98 - _mod97(country, F.lit("00"), new)).cast("string"), 2, "0")
    spaced = F.when(m.contains(" "), F.trim(F.regexp_replace(F.concat(country, checked, new), "(.{4})", "$1 "))).otherwise(F.concat(country, checked, new))
    return F.when((_mod97(country, check, bban) == 1) & (F.length(_digits(bban)) >= 2), spaced).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """North American: ten digits whose area and exchange begin with 2 to 9, permuted among themselves.  Other countries':
    all but the first three digits are permuted.  What is neither stays."""
    d = _digits(m)
    national = F.right(d, F.lit(10))
    area, exchange, line = F.substring(national, 1, 3).cast("long"), F.substring(national, 4, 3).cast("long"), F.substring(national, 7, 4).cast("long")
    american = ((F.length(d) == 10) & ~m.startswith("+")) | ((F.length(d) == 11) & d.startswith("1"))
    valid = american & (area >= 200) & (exchange >= 200)
    out = feistel((area - 200) * 100 + F.floor((exchange - 200) / 8), (exchange - 200) % 8 * 10000 + line, F.lit(80000), F.lit(80000), key, "nanp")
    new_exchange = out["l"] % 100 * 8 + F.floor(out["r"] / 10000) + 200
    new = F.concat((F.floor(out["l"] / 100) + 200).cast("string"), new_exchange.cast("string"), F.lpad((out["r"] % 10000).cast("string"), 4, "0"))
    head = F.substring(d, F.lit(1), F.length(d) - 10)
    other = F.concat(F.substring(d, 1, 3), permute_digits(F.substr(d, F.lit(4)), key, "phone"))
    foreign = m.startswith("+") & ~F.substring(d, 1, 1).isin("0", "1")
    return F.when(valid, _refill(m, F.concat(head, new))).when(foreign, _refill(m, other)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999."""
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    at = F.floor(out["l"] / 99)
    new_area = F.when(at >= 665, at + 2).otherwise(at + 1)
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", pad(new_area, 3), pad(out["l"] % 99 + 1, 2), pad(out["r"] + 1, 4))).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    return F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(out["l"] / 256), out["l"] % 256, F.floor(out["r"] / 256), out["r"] % 256)])


#: Days of 1900 to 2099, in a rectangle of 270 by 271 of which 121 numbers lie outside.
DAYS, DAY_A, DAY_B = 73_049, 270, 271


def _date(m: Column, key: str, shape: str) -> Column:
    """A day that exists becomes another of 1900 to 2099; a walk leaves the 121 numbers outside within 122 steps."""
    day = F.datediff(F.try_to_timestamp(m, F.lit(shape)).cast("date"), F.lit("1900-01-01").cast("date")).cast("long")

    def step(v: Column, i: Column) -> Column:
        out = feistel(F.floor(v / DAY_B), v % DAY_B, F.lit(DAY_A), F.lit(DAY_B), key, "date")
        return F.when((i == 1) | (v >= DAYS), out["l"] * DAY_B + out["r"]).otherwise(v)

    new = F.aggregate(F.sequence(F.lit(1), F.lit(DAY_A * DAY_B - DAYS + 1)), day, step)
    return F.when(day.isNull(), m).otherwise(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), new.cast("int")), shape))


def _email(m: Column, key: str) -> Column:
    """A keyed digest of the address in lower case; a dot or hyphen that ends it is a sentence's."""
    tail = F.regexp_extract(m, r"[.-]*$", 0)
    address = F.lower(F.substring(m, F.lit(1), F.length(m) - F.length(tail)))
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("email"), address), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@"), F.substring(digest, 17, 8), F.lit(".example"), tail)


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 4), F.upper(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("access"), m), 256), 1, 16)))


def _secret(m: Column, key: str) -> Column:
    """The name stays, the value becomes as many hex digits of a keyed digest (over and over if it is long)."""
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_.-]+$", 0)
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("secret"), value), 256)
    n = F.length(value)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - n), F.rpad(digest, n, digest))


def kind_of(m: Column) -> Column:
    """The first shape that a match has as a whole."""
    out = F
    for kind, pattern in SHAPES.items():
        out = out.when(m.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("")


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    made = {
        "email": _email(m, key), "access_key": _access_key(m, key), "secret": _secret(m, key), "iban": _iban(m, key),
        "ssn": _ssn(m, key), "iso_date": _date(m, key, "yyyy-MM-dd"), "dot_date": _date(m, key, "dd.MM.yyyy"),
        "slash_date": _date(m, key, "MM/dd/yyyy"), "ip": _ip(m, key), "card": _card(m, key), "phone": _phone(m, key),
    }
    out = F
    for k, value in made.items():
        out = out.when(kind == k, value)
    return out.otherwise(m)


def pseudonymise(df: DataFrame, key: str, text: str = "text", counts: str | None = None) -> DataFrame:
    """``df`` with the personal data of ``text`` replaced, all other columns as they are.

    ``counts`` names a column to add: how many values of the text were replaced.
    """
    # Inner values stand beside the whole row in structs, so no name can clash.
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    found = inner.select("row", F.when(F.col("row")[text].rlike(GATE), F.regexp_extract_all(F.col("row")[text], F.lit(ANY), F.lit(0))).alias("found"))
    made = found.select(
        "row", "found", F.transform("found", lambda m: pseudonym(m, kind_of(m), key)).alias("made")
    )
    between = F.split(F.col("row")[text], ANY, -1)
    joined = F.array_join(F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("made"), i), F.lit("")))), "")
    new_text = F.when(F.size("found") > 0, joined).otherwise(F.col("row")[text])
    columns = [new_text.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns]
    if counts is not None:
        changed = F.size(F.filter(F.arrays_zip("found", "made"), lambda z: z["found"] != z["made"]))
        columns.append(F.when(F.col("found").isNull(), 0).otherwise(changed).alias(counts))
    return made.select(*columns)
