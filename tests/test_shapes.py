"""Literal tables for shapes, overlays, unread keys, wording, patterns and fixes."""

import json

from pyspark.sql import functions as F

from clausework.functions import texts
from clausework.operators import hints, lists, rewrite, shapes, wording
from clausework.sources import flatten

TRIPLE = "graph_id string, seq long, s string, p string, o_iri string, o_value string"


def graph(spark, rows):
    return spark.createDataFrame([("g", i, s, p, o[1:] if o[0] == "<" else None, None if o[0] == "<" else o) for i, (s, p, o) in enumerate(rows)], TRIPLE)


def listed(df, key="left_iri"):
    out = {}
    for r in df.orderBy("ix").collect():
        out.setdefault((r[key], r["facet"]), []).append(r["value"])
    return out


def cells(name, values):
    out = []
    for i, v in enumerate(values):
        out += [(f"{name}{i}", "rdf:first", v), (f"{name}{i}", "rdf:rest", f"<{name}{i + 1}" if i + 1 < len(values) else "<rdf:nil")]
    return out


def constraint(node, left, *facts):
    return [(node, "sh:property", f"<{node}l"), (node, "sh:property", f"<{node}r"), (f"{node}l", "sh:path", "<odrl:leftOperand"), *[(f"{node}l", "sh:hasValue", f"<{x}") for x in left],
            (f"{node}r", "sh:path", "<odrl:rightOperand"), *[(f"{node}r", p, o) for p, o in facts]]


def test_shapes_unite_in_document_order(spark):
    rows = (
        constraint("n", ["urn:l"], ("sh:in", "<c0"), ("sh:class", "<urn:ignored"))
        + cells("c", ["<urn:b", "<urn:a", "text", "<_:blank"])
        + constraint("m", ["urn:l"], ("sh:in", "<c1"), ("sh:datatype", "<xsd:date"))
        + constraint("k", ["urn:l"], ("sh:class", "<urn:K"), ("sh:node", "<urn:N"), ("sh:datatype", "<xsd:time"), ("sh:minInclusive", "1"))
    )
    found, checks, notes = shapes.read_shapes(graph(spark, rows))
    assert listed(found) == {("urn:l", "values"): ["urn:b", "urn:a"], ("urn:l", "literals"): ["text"], ("urn:l", "classes"): ["urn:K", "urn:N"]}
    assert [tuple(r) for r in checks.collect()] == [("g", "urn:l", "xsd:date", None, None, "1", None)]
    assert {(r.note, r.about) for r in notes.collect()} == {("class beside a list", "nr"), ("second datatype", "urn:l")}


def test_shapes_left_out(spark):
    rows = (
        [("x", "sh:not", "<n"), *constraint("n", ["urn:l"], ("sh:in", "<urn:v"))]
        + constraint("two", ["urn:l", "urn:k"], ("sh:in", "<urn:v"))
        + constraint("long", ["urn:long"], *[("sh:in", f"<urn:v{i}") for i in range(257)])
        + constraint("full", ["urn:full"], *[("sh:in", f"<urn:v{i}") for i in range(256)])
        + constraint("empty", ["urn:empty"], ("sh:in", "<rdf:nil"), ("sh:pattern", "a"), ("sh:flags", "s"))
        + constraint("off", ["urn:off"], ("sh:in", "<urn:v"), ("sh:deactivated", " true"))
        + [("act", "sh:path", "<odrl:action"), ("act", "sh:in", "urn:use"), ("act", "sh:in", "<urn:sell"), ("bare", "sh:path", "<odrl:leftOperand"), ("bare", "sh:in", "ex:count")]
        + [("odd", "sh:path", "<ex:other"), ("lone", "sh:path", "<odrl:unit"), ("lone", "sh:in", "<urn:u"), ("none", "sh:path", "text"), ("idle", "sh:path", "<odrl:leftOperand")]
    )
    found, checks, notes = shapes.read_shapes(graph(spark, rows))
    got = listed(found)
    assert got.pop(("urn:full", "values")) == [f"urn:v{i}" for i in range(256)]
    assert got == {("", "actions"): ["urn:sell", "urn:use"]}
    assert checks.count() == 0
    assert {(r.note, r.about) for r in notes.collect()} == {
        ("several left operands", "two"), ("no left operand", "twor"), ("list longer than is read", "longr"), ("empty list", "emptyr"), ("pattern not read", "emptyr"),
        ("list with a string that is no IRI", "bare"), ("path not read", "odd"), ("no left operand", "lone"), ("no path", "none"), ("neither value nor list", "idle"),
    }


def test_shared_list_is_walked_once_and_graphs_stay_apart(spark):
    values = [f"<urn:v{i}" for i in range(400)]
    rows = cells("c", values) + [r for i in range(20) for r in constraint(f"n{i}", [f"urn:l{i}"], ("sh:in", "<c0"))]
    one = graph(spark, rows)
    found, _, notes = shapes.read_shapes(one.unionByName(one.withColumn("graph_id", F.lit("h"))))
    assert found.groupBy("graph_id", "left_iri").count().where("count = 400").count() == 40
    assert notes.count() == 0


def test_empty_graphs(spark):
    none = spark.createDataFrame([], TRIPLE)
    assert [df.count() for df in (*shapes.read_shapes(none), *shapes.read_overlay(none))] == [0] * 6


def test_overlay(spark):
    rows = [
        ("t", "prose:rightOperand", "<b"), ("t", "prose:rightOperand", "<a"), ("t", "prose:rightOperand", "<b"), ("t", "prose:datatype", "<d1"), ("t", "prose:datatype", "<d2"),
        ("t", "prose:closed", "1"), ("u", "prose:plural", "no"), ("_:x", "prose:unit", "<a"), ("u", "skos:note", "n"), ("u", "rdf:type", "<c"), ("u", "prose:shade", "s"), ("u", "ex:any", "s"),
    ]
    found, facts, notes = shapes.read_overlay(graph(spark, rows))
    assert listed(found) == {("t", "values"): ["b", "a"]}
    assert {tuple(r) for r in facts.collect()} == {("g", "t", "d1", True, False, True), ("g", "u", None, False, False, False)}
    assert {tuple(r) for r in notes.collect()} == {("g", "label or note", "u"), ("g", "type", "u"), ("g", "property not read", "prose:shade")}


def unread(spark, *documents):
    df = spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(documents)], "doc_id long, text string")
    return {(r.doc_id, r.key) for r in rewrite.unread_keys(flatten.flatten(df)).collect()}


def test_unread_keys(spark):
    odrl = "http://www.w3.org/ns/odrl/2/"
    chain = {f"t{i}": f"t{i + 1}" for i in range(10)} | {"t10": odrl + "use"}
    grows = {"@context": {"a": "a:x"}, "a:b": 1}
    data = {"@context": {"raw": {"@id": "ex:raw", "@type": "@json"}, "mixed": [{"@id": "x:y"}]}, "raw": {"odrl:a": {"odrl:b": 1}}, "mixed": {"odrl:c": 1}}
    below = {"x": {"@context": {"n": odrl + "name"}}, "n": 1, "y": {"@value": {"odrl:z": 1}}}
    assert unread(spark, {"odrl:use": 1, "use": 1, odrl: 1, odrl + "x": 1}, {"@context": chain, "t0": 1}, grows, data, below, None, "no json", {"@context": {"p": "p", "q": {"@id": odrl + "q"}}, "p": 1, "q": 1}) == {
        (0, "odrl:use"), (0, odrl + "x"), (1, "t0"), (2, "a:b"), (3, "odrl:c"), (4, "n"),
    }


def test_wording_and_gloss(spark):
    terms = spark.createDataFrame([("p", 1, 0, "urn:x#sell", "Action", False), ("q", 2, 0, "urn:x#sell", "Unit", True), ("q", 2, 1, "urn:x#near", "Operator", False)],
                                  "profile_id string, load_order int, term_ix int, iri string, kind string, deprecated boolean")
    texts = spark.createDataFrame([("p", "urn:x#sell", "label", "Sell On", "en", 0), ("q", "urn:x#near", "label", "Has Part", None, 0)], "profile_id string, iri string, p string, text string, lang string, ix int")
    named = wording.declared(terms, texts, ["en"])
    uses = spark.createDataFrame([("x:sell", "urn:x#sell", "Action", None), ("x:sell", "urn:x#sell", "Unit", None), ("x:near", "urn:x#near", "Operator", True), ("payAmount", "urn:none", "LeftOperand", None)],
                                 "written string, iri string, kind string, plural boolean").withColumns({"left": F.lit("count"), "shape": F.lit("Number")})
    got = {(r.kind, r.phrase) for r in wording.wording(uses, named).collect()}
    assert {x for x in got if x[0] != "LeftOperand"} == {("Action", "sell on"), ("Unit", "Sell On"), ("Operator", "have part")}
    links = spark.createDataFrame([("urn:x#sell", "urn:x#near", "broader", 0), ("urn:x#sell", "https://up.example/x#useIt", "includedIn", 5), ("urn:x#sell", "urn:x#near", "includedIn", 6)], "child string, parent string, predicate string, ix int")
    titles = spark.createDataFrame([("p", "The profile")], "profile_id string, title string")
    entry = {r.kind: r for r in wording.gloss(uses, named, links, titles).collect()}
    assert set(entry) == {"Action", "Operator"}
    sell = entry["Action"]
    assert [tuple(x) for x in sell.broader] == [("https://up.example/x#useIt", "use it"), ("urn:x#near", "Has Part")]
    assert (sell.label, sell.implies, sell.profile, sell.deprecated) == ("Sell On", [], "The profile", False)


def test_patterns(spark):
    cases = [("AB", "^ab$", "i", False), ("AB", "^ab$", None, True), ("٣", r"^\d$", "", False), ("a b", r"a\sb", "", True), (r"\d", r"^\\d$", "", False), ("é", r"^\w$", "", False), ("x", None, "i", False), (None, "a", "", None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, v string, p string, f string")
    got = [r[0] for r in df.orderBy("i").select(hints.pattern_mismatch(F.col("v"), F.col("p"), F.col("f"))).collect()]
    assert got[:-1] == [c[3] for c in cases[:-1]]
    assert not got[-1]


def test_fixes(spark):
    found = spark.createDataFrame([(1, "a", "action", "x:y", "profile.unbound-prefix"), (1, "b", "left", "x:z", "profile.not-declared"), (1, "c", "left", "q", "profile.unknown-term")], "doc_id long, path string, slot string, written string, rule string")
    expanded = spark.createDataFrame([(1, "a", "action", "x:y", "urn:y"), (1, "b", "left", "x:z", "urn:z"), (1, "c", "left", "q", "urn:q")], "doc_id long, path string, slot string, written string, iri string")
    terms = spark.createDataFrame([("p", 1, 0, "urn:z"), ("q", 2, 0, "urn:z")], "profile_id string, load_order int, term_ix int, iri string")
    profiles = spark.createDataFrame([("p", "urn:p"), ("q", "urn:q")], "profile_id string, iri string")
    hinted = spark.createDataFrame([(1, "k", "prose.iri-expected"), (1, "k", "prose.datatype-lexical")], "doc_id long, path string, rule string")
    constraints = spark.createDataFrame([(1, "k", "urn:v"), (1, "other", "urn:w")], "doc_id long, path string, raw string")
    twice = spark.createDataFrame([(1, "r", 2, True), (1, "r", 3, False)], "doc_id long, owner string, ix int, removable boolean")
    groups = spark.createDataFrame([(1, "m", "heuristic.single-child-group"), (1, "n", "heuristic.ordered-on-unordered")], "doc_id long, path string, rule string")
    got = {(r.path, r.label, r.replacement) for r in lists.fixes(found, expanded, terms, profiles, hinted, constraints, twice, groups).collect()}
    assert got == {("a", "Write the full IRI", "urn:y"), ("b", "Declare the profile <urn:p>", "urn:p"), ("k", "Write it as an IRI", "urn:v"), ("r.action[2]", "Remove the duplicate", ""), ("m", "Ungroup", "")}


def test_canonical_json(spark):
    cases = {'{"b":1.0,"a":[ ]}': '{"a":[],"b":1}', "3": "3", '"x"': '"x"', "null": "null", "": None, "1,2": None, "1],[2": None, "1} x": None, '1,"w":2': None, '{"a":1}}': None, "{": None, None: None}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, a string")
    got = [r[0] for r in df.orderBy("i").select(texts.canonical_json(F.col("a"))).collect()]
    assert got == list(cases.values())
