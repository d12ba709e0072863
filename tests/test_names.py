"""Literal tables for the text functions."""

import pytest
from pyspark.sql import functions as F

from clausework.functions import names


def run(spark, rows, make, cols="a string, b string"):
    df = spark.createDataFrame(rows, cols)
    return [r[0] for r in df.select(make).collect()]


def test_local_and_short_names(spark):
    terms = [("http://www.w3.org/ns/odrl/2/use", ""), ("odrl:use", ""), ("ex:a:b", ""), ("http://x.org/a#b", ""), ("plain", "")]
    assert run(spark, terms, names.local_name(F.col("a"))) == ["use", "use", "b", "b", "plain"]
    iris = [("http://example.com/asset:9898.movie", ""), ("http://example.com/person:88", ""), ("did:web:x", ""), ("http://x.org/a/", ""), ("///", "")]
    assert run(spark, iris, names.short_iri(F.col("a"))) == ["9898.movie", "person:88", "did:web:x", "a", "///"]


def test_humanise(spark):
    rows = [("payAmount", ""), ("pay_amount", ""), ("HTTPServer", ""), ("a-b", ""), ("x2Y", "")]
    assert run(spark, rows, names.humanise(F.col("a"))) == ["pay amount", "pay amount", "httpserver", "a b", "x2 y"]


@pytest.mark.parametrize(
    "text,words",
    [
        ("P1Y6M", "1 year and 6 months"),
        ("-P2D", "minus 2 days"),
        ("PT1.5S", "1.5 seconds"),
        ("P0D", "0 days"),
        ("P1Y2M3DT4H", "1 year, 2 months, 3 days and 4 hours"),
        ("P2W", "2 weeks"),
        ("PT", None),
        ("P", None),
        ("P1H", None),
        ("x", None),
    ],
)
def test_durations(spark, text, words):
    assert run(spark, [(text, "")], names.duration_words(F.col("a"))) == [words]


def test_value_shapes(spark):
    rows = [
        ("2026-01-02", None, "DateOnly"),
        ("2026-01-02Z", "xsd:date", "DateOnly"),
        ("2026-01-02Z", None, "Other"),
        ("2026-01-02T10:00", None, "Instant"),
        ("x", "xsd:dateTime", "Instant"),
        ("P1D", None, "Duration"),
        ("P1D", "xsd:duration", "Duration"),
        ("1", "xsd:integer", "Other"),
    ]
    got = run(spark, [(a, b) for a, b, _ in rows], names.value_shape(F.col("a"), F.col("b")))
    assert got == [c for *_, c in rows]


def test_lexical_spaces(spark):
    good = {
        "integer": ["0", "-3", "+7", "0042"],
        "decimal": ["1.", ".5", "-1.25"],
        "boolean": ["true", "0"],
        "date": ["2026-12-31", "-0001-01-01+14:00"],
        "dateTime": ["2026-01-01T24:00:00", "2026-01-01T23:59:59.5Z"],
        "duration": ["P1Y", "PT1.5S", "-P1DT2H"],
    }
    bad = {"integer": ["", "-", "1.0", "1e3"], "decimal": ["."], "boolean": ["TRUE"], "date": ["2026-13-01"], "dateTime": ["2026-01-01T24:00:01"], "duration": ["P1W", "PT", "P"]}
    for want, table in ((True, good), (False, bad)):
        rows = [(t, f"xsd:{d}") for d, ts in table.items() for t in ts]
        assert run(spark, rows, names.xsd_valid(F.col("b"), F.col("a"))) == [want] * len(rows)


def test_quotes_urls_and_ranges(spark):
    rows = [("a b", ""), ("ex:a", ""), ("12.5", ""), ("1e3", ""), ("2026-01-01x", ""), ("word", "")]
    assert run(spark, rows, names.quoted(F.col("a"))) == ['"a b"', "ex:a", "12.5", "1e3", "2026-01-01x", '"word"']
    assert run(spark, [("see http://a.b/c, (https://d.e). http://a.b/c", "")], names.http_urls(F.col("a"))) == [["http://a.b/c", "https://d.e"]]
    assert run(spark, [("de-AT-x", "")], names.shorter_ranges(F.col("a"))) == [["de-AT-x", "de-AT", "de"]]


def test_joined_lists(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r[0] for r in df.select(names.join_and(F.col("x"))).collect()] == ["", "a", "a and b", "a, b and c"]


def test_operator_phrases(spark):
    rows = [("dateTime", "lt", "DateOnly", "are before the start of"), ("dateTime", "gteq", "Instant", "are on or after"), ("dateTime", "eq", "DateOnly", "are equal to"),
            ("count", "hasPart", "Other", "has as a part"), ("count", "odrl:lteq", "Other", "is at most"), ("count", "ex:isNear", "Other", "is related by is near to")]
    df = spark.createDataFrame([r[:3] for r in rows], "l string, o string, s string")
    assert [r[0] for r in df.select(names.operator_phrase(F.col("l"), F.col("o"), F.col("s"))).collect()] == [r[3] for r in rows]
