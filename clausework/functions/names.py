"""Names, phrases and lexical checks as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.model import ACTION_PHRASES, ODRL, OPERAND_PHRASES, OPERATOR_PHRASES


def local_name(term: Column) -> Column:
    """The part of a term after its namespace or prefix."""
    return (
        F.when(term.startswith(ODRL), F.substr(term, F.lit(len(ODRL) + 1)))
        .when(term.startswith("odrl:"), F.substr(term, F.lit(6)))
        .when(term.contains("://"), F.regexp_extract(term, r"[^#/]*$", 0))
        .otherwise(F.substring_index(term, ":", -1))
    )


def short_iri(iri: Column) -> Column:
    """Last segment of an IRI, with the one before where the last has no letter; a DID as it is."""
    trimmed = F.regexp_replace(iri, r"[/#:]+$", "")
    last = F.regexp_extract(trimmed, r"[^/#:]*$", 0)
    two = F.regexp_extract(trimmed, r"[^/#:]+[/#:][^/#:]*$", 0)
    short = F.when(last.rlike(r"\p{L}") | (two == ""), last).otherwise(two)
    return F.when(iri.startswith("did:"), iri).when(short == "", iri).otherwise(short)


def humanise(name: Column) -> Column:
    """``payAmount`` and ``pay_amount`` are ``pay amount``."""
    return F.lower(F.translate(F.regexp_replace(name, r"(?<=[\p{Ll}0-9])(\p{Lu})", " $1"), "-_", "  "))


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def operand_phrase(left: Column) -> Column:
    local = local_name(left)
    return F.coalesce(_table(OPERAND_PHRASES)[local], F.concat(F.lit("the "), humanise(local)))


def operator_phrase(left: Column, op: Column, shape: Column) -> Column:
    """The verb phrase after ``left``: a point in time has its own, and takes a plural verb."""
    local, moment = local_name(op), local_name(left) == "dateTime"
    timed = F.when(shape == "DateOnly", _table(OPERATOR_PHRASES["day"])[local]).otherwise(_table(OPERATOR_PHRASES["instant"])[local])
    phrase = F.coalesce(F.when(moment, timed), _table(OPERATOR_PHRASES["any"])[local], F.concat(F.lit("is related by "), humanise(local), F.lit(" to")))
    return F.when(moment, F.regexp_replace(F.regexp_replace(phrase, "^is ", "are "), "^has ", "have ")).otherwise(phrase)


def action_phrase(action: Column) -> Column:
    local = local_name(action)
    return F.coalesce(_table(ACTION_PHRASES)[local], humanise(local))


def join_and(items: Column, conjunction: str | Column = "and") -> Column:
    """``a, b and c``."""
    word = F.lit(conjunction) if isinstance(conjunction, str) else conjunction
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" "), word, F.lit(" "), F.element_at(items, -1))
    )


def _amounts(text: Column, units: list[tuple[str, str]]) -> list[Column]:
    out = []
    for mark, unit in units:
        number = F.regexp_replace(F.regexp_extract(text, rf"([0-9]+(?:\.[0-9]+)?){mark}", 1), r"^0+(?=[0-9])", "")
        out.append(F.when(number != "", F.struct(number.alias("n"), F.lit(unit).alias("unit"))))
    return out


def duration_words(text: Column) -> Column:
    """``P1Y6M`` is ``1 year and 6 months``; what is no duration is null."""
    valid = text.rlike(r"^-?P(?=[0-9T])([0-9]+Y)?([0-9]+M)?([0-9]+W)?([0-9]+D)?(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?$")
    date, time = F.substring_index(text, "T", 1), F.regexp_extract(text, "T(.*)$", 1)
    parts = F.array_compact(
        F.array(*_amounts(date, [("Y", "year"), ("M", "month"), ("W", "week"), ("D", "day")]), *_amounts(time, [("H", "hour"), ("M", "minute"), ("S", "second")]))
    )
    told = F.filter(parts, lambda p: p["n"].rlike("[1-9]"))
    words = join_and(F.transform(told, lambda p: F.concat(p["n"], F.lit(" "), p["unit"], F.when(p["n"] == "1", "").otherwise("s"))))
    last = F.element_at(parts, -1)
    none = F.concat(last["n"], F.lit(" "), last["unit"], F.lit("s"))
    return F.when(valid, F.when(F.size(told) == 0, none).otherwise(F.concat(F.when(text.startswith("-"), "minus ").otherwise(""), words)))


DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})?"


def value_shape(value: Column, datatype: Column) -> Column:
    """Instant, DateOnly, Duration or Other."""
    local = F.regexp_extract(datatype, r"^(?:http://www\.w3\.org/2001/XMLSchema#|xsd:|xs:)(.*)$", 1)
    duration = duration_words(value).isNotNull()
    instant = value.rlike(rf"^{DAY}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\.[0-9]+)?)?{ZONE}$")
    plain = (
        F.when(value.rlike(f"^{DAY}$"), "DateOnly").when(duration, "Duration").when(instant, "Instant").otherwise("Other")
    )
    typed = (
        F.when((local == "date") & value.rlike(f"^{DAY}{ZONE}$"), "DateOnly")
        .when((local == "duration") & duration, "Duration")
        .when(local.isin("dateTime", "dateTimeStamp"), "Instant")
        .otherwise("Other")
    )
    return F.when(datatype.isNull(), plain).otherwise(typed)


# The lexical spaces that are checked.
_TZ = r"(Z|[+-](0[0-9]|1[0-4]):[0-5][0-9])?"
_D = r"-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
LEXICAL = {
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$",
    "boolean": r"^(true|false|1|0)$",
    "date": rf"^{_D}{_TZ}$",
    "dateTime": rf"^{_D}T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.[0-9]+)?){_TZ}$",
    "duration": r"^-?P(?=[0-9T])([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=[0-9.])([0-9]+H)?([0-9]+M)?(([0-9]+\.?[0-9]*|\.[0-9]+)S)?)?$",
}


def xsd_valid(datatype: Column, text: Column) -> Column:
    """Whether a text is in its datatype's lexical space; null for datatypes that are not checked."""
    local = F.regexp_extract(datatype, r"^(?:http://www\.w3\.org/2001/XMLSchema#|xsd:|xs:)(.*)$", 1)
    out = F
    for name, pattern in LEXICAL.items():
        out = out.when(local == name, text.rlike(pattern))
    return out.otherwise(F.lit(None).cast("boolean"))


def quoted(text: Column) -> Column:
    """In quotes, unless it looks like an IRI, a number or a date."""
    number = text.rlike(r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$")
    date = text.rlike("^.{4}-.{2}-.{2}")
    plain = ~text.rlike(r"\s") & (text.contains(":") | number | date)
    return F.when(plain, text).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def namespace(iri: Column) -> Column:
    """What stands before the last # or /, with it."""
    return F.regexp_extract(iri, r"^.*[#/]", 0)


def trim_iri(iri: Column) -> Column:
    """Without trailing # and /."""
    return F.regexp_replace(iri, "[#/]+$", "")


def iri_ok(iri: Column) -> Column:
    """No white space, invisible characters or characters that an IRI can't hold."""
    return ~iri.rlike(r'[\s\p{C}<>"{}|\\^`]') & (iri != "")


def http_urls(text: Column) -> Column:
    """The http and https URLs of a text in order, each once, without punctuation at the end."""
    found = F.regexp_extract_all(text, F.lit(r'https?://[^\s"<>]+'), F.lit(0))
    cut = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?')\]}]+$", ""))
    return F.array_distinct(F.filter(cut, lambda u: u.rlike("^https?://.")))


def shorter_ranges(tag: Column) -> Column:
    """A language tag and its shortenings: ``de-AT-x`` gives de-AT-x, de-AT, de."""
    parts = F.split(tag, "-")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
