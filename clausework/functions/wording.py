"""Dates, labels, references and slugs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions.names import quoted


def when_text(stamp: Column) -> Column:
    """``2026-10-15T10:00:00Z`` is ``on 2026-10-15 at 10:00 UTC``; what is no date or time is ``at`` the text."""
    date = F.substring_index(stamp, "T", 1)
    time = F.when(stamp.contains("T"), F.regexp_extract(stamp, "^[^T]*T(.*)$", 1)).otherwise("")
    is_date = date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    offset = F.regexp_extract(time, r"([+-].{5})$", 1)
    clock = F.when(time.endswith("Z"), F.regexp_replace(time, "Z$", "")).when(offset != "", F.regexp_replace(time, r"[+-].{5}$", "")).otherwise(time)
    zone = F.when(time.endswith("Z"), " UTC").when(offset != "", F.concat(F.lit(" UTC"), offset)).otherwise("")
    is_clock = clock.rlike(r"^[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$")
    short = F.when(clock.rlike(r"^.{5}:00$"), F.substring(clock, 1, 5)).otherwise(clock)
    other = F.concat(F.lit("at "), quoted(stamp))
    told = F.when(is_clock, F.concat(F.lit("on "), date, F.lit(" at "), short, zone)).otherwise(other)
    return F.when(~is_date, other).when(time == "", F.concat(F.lit("on "), date)).otherwise(told)


def label_in_sentence(label: Column) -> Column:
    """A label inside a sentence: plain capitalised words of a title in lower case, else the first letter, acronyms kept."""
    words = F.split(label, " ")
    title = (F.size(words) > 1) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    plain = lambda w: w.rlike(r"^\p{Lu}[^\p{Lu}-]*$") | w.rlike(r"^\p{Lu}[^\p{Lu}-]+(-\p{Lu}[^\p{Lu}-]+)+$")
    lowered = F.array_join(F.transform(words, lambda w: F.when(plain(w), F.lower(w)).otherwise(w)), " ")
    first = F.concat(F.lower(F.substring(label, 1, 1)), F.substr(label, F.lit(2)))
    return F.when(title, lowered).when(label.rlike(r"^.\p{Lu}"), label).otherwise(first)


def article(label: Column) -> Column:
    """``the`` before a label that has no article."""
    return F.when(F.lower(label).rlike("^(the|a|an) "), label).otherwise(F.concat(F.lit("the "), label))


def resolve_iri(base: Column, ref: Column) -> Column:
    """``ref`` against an absolute ``base``; dot segments stay."""
    no_fragment = F.substring_index(base, "#", 1)
    no_query = F.substring_index(no_fragment, "?", 1)
    scheme = F.substring_index(no_query, ":", 1)
    authority = F.regexp_extract(no_query, r"^[^:]*:(//[^/]*)?", 0)
    folder = F.regexp_extract(no_query, r"^([^:]*:(?://)?[^/].*/)[^/]*$", 1)
    relative = F.when(folder != "", F.concat(folder, ref)).otherwise(F.concat(no_query, F.lit("/"), ref))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref == "", no_fragment)
        .when(ref.startswith("#"), F.concat(no_fragment, ref))
        .when(ref.startswith("?"), F.concat(no_query, ref))
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(authority, ref))
        .otherwise(relative)
    )


def slug(path: Column) -> Column:
    """A file's last two folders and name, without those that all projects have, in lower case with hyphens."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.json(ld)?$", ""), "/"), lambda p: ~p.isin("resources", "src", "main", "example", "examples"))
    n = F.size(parts)
    tail = F.when(n > 2, F.slice(parts, n - 1, F.lit(2))).otherwise(parts)
    return F.lower(F.regexp_replace(F.array_join(tail, "-"), "[^A-Za-z0-9]", "-"))


def title(slug: Column) -> Column:
    text = F.replace(slug, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cell(text: Column) -> Column:
    return F.replace(one_line(text), F.lit("|"), F.lit("/"))
