"""Texts of vocabularies and policies made fit to show: plain text, escapes, notes, exit codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions.wording import when_text
from clausework.model import ODRL

# White space and what renders as nothing, by code point.
SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INVISIBLE = (
    r"\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFFB}"
    r"\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
)
# What may forge lines or move a cursor in a report.
UNSAFE = r"\x{0}-\x{1F}\x{7F}-\x{9F}\x{61C}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2066}-\x{2069}"
# The named references that are decoded.
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}
#: A tag: "<" opens one only before a letter, "/", "!" or "?"; without an end it runs to the end of the text.
TAG = r"<[A-Za-z/!?][^>]*(>|$)"
#: A reference has ten characters at most between "&" and ";".
REFERENCE = r"&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]{1,9}|#\+[0-9]{1,8}|#[xX][0-9A-Fa-f]{1,8}|#[xX]\+[0-9A-Fa-f]{1,7});"


def character(code: Column) -> Column:
    """The character of a code point; null for what is none."""
    valid = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_references(text: Column) -> Column:
    """The XML references, ``&nbsp;`` (as a space) and numeric ones decoded once; anything else stays as written."""

    def decoded(piece: Column) -> Column:
        hexed, tens = F.regexp_extract(piece, r"^&#[xX]\+?([0-9A-Fa-f]+);$", 1), F.regexp_extract(piece, r"^&#\+?([0-9]+);$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(tens != "", tens).cast("long")
        named = F
        for written, meant in NAMED.items():
            named = named.when(piece == written, meant)
        return F.when(F.length(piece) > 1, F.coalesce(named.otherwise(None), character(code))).otherwise(None)

    pieces = F.regexp_extract_all(text, F.lit(f"{REFERENCE}|[^&]+|&"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("&"), F.coalesce(decoded(p), p)).otherwise(p)), "")


def plain(text: Column, most: int | None = None) -> Column:
    """Without tags, references decoded, invisible characters gone, white space collapsed.

    A text of more than ``most`` characters is cut there and ends in an ellipsis.
    """
    decoded = decode_references(F.regexp_replace(text, TAG, " "))
    shown = F.regexp_replace(F.regexp_replace(decoded, f"[{INVISIBLE}]+", ""), f"[{SPACE}]+", " ")
    shown = F.trim(shown)
    if most is None:
        return shown
    if most == 0:
        return F.when(text.isNotNull(), "")
    return F.when(F.length(shown) <= most, shown).otherwise(F.concat(F.rtrim(F.substring(shown, 1, most - 1)), F.lit("…")))


def safe_text(text: Column) -> Column:
    """Control and bidirectional characters as escapes."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{UNSAFE}]|[^{UNSAFE}]+"), F.lit(0))

    def escaped(piece: Column) -> Column:
        code = F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(piece))), F.lit("}"))
        return F.when(piece == "\n", "\\n").when(piece == "\r", "\\r").when(piece == "\t", "\\t").otherwise(code)

    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{UNSAFE}]"), escaped(p)).otherwise(p)), "")


def metadata_term(key: Column) -> Column:
    """timestamp or summary, if a policy's key spells one; else null."""
    local = (
        F.when(key.startswith(ODRL), F.substr(key, F.lit(len(ODRL) + 1)))
        .when(key.rlike("^(odrl|dspace):"), F.regexp_replace(key, "^[a-z]+:", ""))
        .when(key.rlike("^https://w3id[.]org/dspace/.*/"), F.substring_index(key, "/", -1))
        .otherwise(key)
    )
    return F.when(local.isin("timestamp", "summary"), local)


def metadata_note(term: Column, agreement: Column, value: Column, lang: Column) -> Column:
    """``Agreed on ...``, ``Issued on ...`` or ``Summary (en): ...``; null for a blank value."""
    text = F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", "")
    stamp = F.concat(F.when(agreement, "Agreed ").otherwise("Issued "), when_text(text), F.lit("."))
    label = F.when(lang.isNotNull(), F.concat(F.lit("Summary ("), lang, F.lit(")"))).otherwise("Summary")
    summary = F.concat(label, F.lit(": "), text, F.when(text.rlike("[.!?]$"), "").otherwise("."))
    return F.when(text != "", F.when(term == "timestamp", stamp).when(term == "summary", summary))


def policy_type_iri(written: Column, iri: Column) -> Column:
    """The type's IRI; an empty type and the base class alone stand for a set."""
    return F.when((written == "") | (iri == ODRL + "Policy"), ODRL + "Set").otherwise(iri)


def rule_exit(verdict: Column, unreadable: Column) -> Column:
    """The exit code of one report: 0 conforms, 1 violations, 3 incomplete, 2 unreadable or unknown."""
    return F.when(unreadable, 2).when(verdict == "conforms", 0).when(verdict == "violations", 1).when(verdict == "incomplete", 3).otherwise(2)


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order and no white space, to compare documents by; null where the text is no JSON.

    Numbers are written by their value (``5.0`` is ``5``), so the text is a key, not a copy.
    The parser stops after one value; only a whole value parses both as an entry and as a member, so text behind it is seen.
    """
    entry = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(entry.isNotNull() & member.isNotNull(), F.to_json(F.variant_get(member, "$.v", "variant")))
