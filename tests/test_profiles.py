"""Literal tables for texts made plain, headers, shapes and lists."""

from pyspark.sql import functions as F

from clausework.functions import texts
from clausework.operators import profiles, prose, rewrite, structure, vocabulary
from clausework.sources import flatten

TRIPLE = "graph_id string, seq long, s string, p string, o_iri string, o_value string, o_lang string"


def shown(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, a string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("a"))).collect()]


def test_plain(spark):
    cases = {
        "<p>a</p><br/>b": "a b",
        "1 < 2 <3 <!-- c --> d": "1 < 2 <3 d",
        "open <a href='x": "open",
        "&amp;lt; &#65;&#x42;&nbsp;c": "&lt; AB c",
        "&#xD800; &#1114112; &bogus; & &;": "&#xD800; &#1114112; &bogus; & &;",
        "&#128512;": "😀",
        "&#00000000065;": "&#00000000065;",
        "a​b ­ ‮c": "ab c",
        "　 x \ty ": "x y",
        "": "",
        None: None,
    }
    assert shown(spark, list(cases), texts.plain) == list(cases.values())
    assert shown(spark, ["abcdef", "abc def", "abcd", ""], lambda a: texts.plain(a, 5)) == ["abcd…", "abc…", "abcd", ""]
    assert shown(spark, ["abc", None], lambda a: texts.plain(a, 0)) == ["", None]
    long = "<i>&amp;</i> word " * 100_000
    assert shown(spark, [long], texts.plain) == [" ".join(["& word"] * 100_000)]


def test_safe_text(spark):
    values = ["a\nb\r\t", "‮x⁦", "\u0000\u007f\u009f", "plain é", "", None]
    assert shown(spark, values, texts.safe_text) == ["a\\nb\\r\\t", "\\u{202e}x\\u{2066}", "\\u{0}\\u{7f}\\u{9f}", "plain é", "", None]


def test_metadata(spark):
    keys = ["timestamp", "odrl:summary", "dspace:timestamp", "https://w3id.org/dspace/2024/1/summary", "https://w3id.org/dspace/summary", "ex:summary", None]
    assert shown(spark, keys, texts.metadata_term) == ["timestamp", "summary", "timestamp", "summary", None, None, None]
    rows = [("timestamp", True, " 2026-01-02 ", None), ("timestamp", False, "2026-01-02", None), ("summary", True, "Well.", "en"), ("summary", True, "x", None), ("summary", True, " ", None), ("other", True, "x", None)]
    df = spark.createDataFrame(rows, "t string, a boolean, v string, l string")
    got = [r[0] for r in df.select(texts.metadata_note(F.col("t"), F.col("a"), F.col("v"), F.col("l"))).collect()]
    assert got == ["Agreed on 2026-01-02.", "Issued on 2026-01-02.", "Summary (en): Well.", "Summary: x.", None, None]


def test_exit_codes(spark):
    verdicts = ["conforms", "violations", "incomplete", "other", None]
    assert shown(spark, verdicts, lambda v: texts.rule_exit(v, F.lit(False))) == [0, 1, 3, 2, 2]
    assert shown(spark, ["conforms"], lambda v: texts.rule_exit(v, F.lit(True))) == [2]


def test_headers(spark):
    rows = [
        ("a", 1, "urn:x", "rdfs:label", None, " ", "en"),
        ("a", 2, "_:h", "rdf:type", "owl:Ontology", None, None),
        ("a", 3, "urn:later", "rdf:type", "prof:Profile", None, None),
        ("a", 4, "_:h", "rdfs:label", None, "<b></b>", "en"),
        ("a", 5, "_:h", "skos:prefLabel", None, "Titel", "de"),
        ("a", 6, "_:h", "skos:prefLabel", None, "Title", "en"),
        ("a", 7, "_:h", "prof:isProfileOf", "urn:core", None, None),
        ("a", 8, "_:h", "owl:imports", "_:no", None, None),
        ("a", 9, "_:h", "owl:imports", "urn:base", None, None),
        ("b", 1, "urn:t1", "rdfs:isDefinedBy", "urn:q", None, None),
        ("b", 2, "urn:t2", "rdfs:isDefinedBy", "urn:p", None, None),
        ("b", 3, "urn:q", "dct:title", None, "Q", None),
        ("c", 1, "urn:t", "rdf:type", "odrl:Action", None, None),
    ]
    got = profiles.profile_headers(spark.createDataFrame(rows, TRIPLE), ["en"]).orderBy("graph_id").collect()
    assert [tuple(r) for r in got] == [("a", None, "Title", None, None, ["urn:base", "urn:core"]), ("b", "urn:q", "Q", None, None, []), ("c", None, None, None, None, [])]
    assert profiles.profile_headers(spark.createDataFrame([], TRIPLE), ["en"]).collect() == []


def test_skipped_shapes(spark):
    rows = [
        ("g", 1, "a", "sh:not", "b", None, None), ("g", 2, "b", "sh:or", "l", None, None), ("g", 3, "l", "rdf:rest", "m", None, None), ("g", 4, "m", "rdf:first", "b", None, None),
        ("g", 5, "b", "ex:see", "free", None, None), ("h", 6, "b", "sh:or", "other", None, None), ("h", 7, "off", "sh:deactivated", None, "1", None), ("h", 8, "off", "sh:or", "on", None, None),
    ]
    got = {tuple(r) for r in profiles.skipped_shapes(spark.createDataFrame(rows, TRIPLE)).collect()}
    assert got == {("g", "b"), ("g", "l"), ("g", "m"), ("h", "off")}


def test_lists(spark):
    rows = [("o", "values", 0, 0, "b"), ("o", "values", 0, 1, "a"), ("o", "values", 1, 0, "a"), ("o", "values", 1, 1, "c"), ("o", "values", 1, 2, "d")]
    items = spark.createDataFrame(rows, "left_iri string, facet string, shape_ix int, ix int, value string")
    assert [(r.ix, r.value, r.n_more) for r in profiles.union_facets(items, 3).orderBy("ix").collect()] == [(0, "b", 1), (1, "a", 1), (2, "c", 1)]
    assert profiles.same_shapes(items, items.union(items)).collect() == []
    assert {(r.only_in, r.value) for r in profiles.same_shapes(items.where("value <> 'b'"), items.where("value <> 'c'")).collect()} == {("a", "c"), ("b", "b")}
    host = spark.createDataFrame([("o", "a"), ("o", "z"), ("o", "z"), ("free", "x")], "left_iri string, value string")
    assert [tuple(r) for r in profiles.widened_values(host, items).collect()] == [("o", "z")]


def test_trimmed_without_licence(spark):
    head = [("g", 1, "urn:o", "rdf:type", "owl:Ontology", None, None), ("g", 2, "t", "rdf:type", "odrl:Action", None, None), ("g", 3, "t", "ex:x", "y", None, None)]
    licence = [("g", 4, "urn:o", "dct:license", "urn:l", None, None)]
    assert profiles.trim_vocabulary(spark.createDataFrame(head, TRIPLE)).collect() == []
    assert {r.seq for r in profiles.trim_vocabulary(spark.createDataFrame(head + licence, TRIPLE)).collect()} == {1, 2, 4}


def test_duplicate_actions(spark):
    rows = [(1, "r", 0, "use", "x"), (1, "r", 1, "use", "y"), (1, "r", 2, "use", "x"), (1, "r", 3, "use", None), (1, "r", 4, "use", None), (1, "r", 5, "play", "x"), (1, "s", 0, "use", "x")]
    df = spark.createDataFrame(rows, "doc_id long, owner string, ix int, iri string, refinements string")
    got = sorted((r.ix, r.removable) for r in structure.duplicate_actions(df).collect())
    assert got == [(1, False), (2, True), (3, False), (4, True)]


def test_sentences_of_several_parties(spark):
    df = spark.createDataFrame([("permission", ["a", "b"], ["c", "d", "e"]), ("prohibition", ["a"], []), ("obligation", [], [])], "k string, by array<string>, to array<string>")
    got = [r[0] for r in df.select(prose.parties_sentence(F.col("k"), F.col("by"), F.col("to"), F.lit("use"), F.lit(" t"))).collect()]
    assert got == ["c, d and e may use t, as permitted by the assigners a and b.", "No one may use t, as prohibited by the assigner a.", "The assignee must use t."]


def test_notes_without_rules(spark):
    rows = [
        (0, ["Summary: x."], ["P", "Q"], "odrl:invalid", ["a", "b"], 0, ["a", "b"], True),
        (1, [], [], None, ["a"], 0, ["z"], False),
        (2, [], [], "ex:newest", ["a"], 0, [], None),
        (3, [], [], None, [], 0, [], None),
    ]
    df = spark.createDataFrame(rows, "id int, metadata array<string>, profiles array<string>, conflict string, parents array<string>, n_rules long, missing array<string>, missing_are_parents boolean")
    got = [(r.id, r.note) for r in prose.policy_notes(df, ["id"]).orderBy("id", "ix").collect()]
    assert got == [
        (0, "Summary: x."),
        (0, "Written to the profile P and Q."),
        (0, "If a permission and a prohibition conflict, the whole policy is void."),
        (0, "All of its rules come from the parent policies a and b, which are not in this document."),
        (1, "All of its rules come from the ancestor policy z, which is not in this document."),
        (2, "Conflicts are resolved by the strategy newest."),
        (2, "Inherits the rules of a, but no rule comes from there."),
    ]


def test_labels(spark):
    rows = [("a", "rdfs:label", " ", "en", 0), ("a", "dct:title", "t", "en", 1), ("b", "skos:prefLabel", "de", "de", 0), ("b", "skos:prefLabel", "gb", "en-GB", 1), ("c", "schema:name", "n ", "it", 0), ("d", "ex:x", "x", None, 0)]
    df = spark.createDataFrame(rows, "s string, p string, text string, lang string, ix int")
    assert {tuple(r) for r in vocabulary.node_label(df, ["s"], ["fr"]).collect()} == {("b", "gb"), ("c", "n")}


def test_unread_contexts(spark):
    docs = [
        (1, '{"@context": "http://www.w3.org/ns/odrl.jsonld", "permission": {"target": 1}}'),
        (2, '[{"@context": ["x", {"@import": "y", "z": {"@context": "scoped"}}, "x"]}, {"@graph": {"@context": "g", "a": {"@context": {}}, "b": {"@context": null}}}]'),
        (3, '{"@value": {"@context": "data"}, "@graph": [{"@graph": {"@context": "deep"}}]}'),
        (4, "no json"),
        (5, None),
    ]
    rows = flatten.flatten(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {tuple(r) for r in rewrite.unread_contexts(rows).collect()}
    assert got == {(2, "remote", "x"), (2, "remote", "y"), (2, "remote", "g"), (2, "nested", None), (3, "nested", None)}


def test_labels_by_full_names(spark):
    rows = [("a", "https://schema.org/name", "n", None, 0), ("a", "dcterms:title", "t", None, 1), ("b", "http://www.w3.org/2000/01/rdf-schema#label", "l", "en", 0), ("b", "skos:prefLabel", "p", "en", 1), ("c", "urn:label", "x", None, 0)]
    df = spark.createDataFrame(rows, "s string, p string, text string, lang string, ix int")
    assert {(r.s, r.label) for r in vocabulary.node_label(df, ["s"], ["en"]).collect()} == {("a", "t"), ("b", "l")}
