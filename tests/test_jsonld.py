"""Profiles as JSON-LD: literal documents."""

import json

from clausework.operators import jsonld, shapes
from clausework.sources import flatten


def read(spark, *documents):
    df = spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(documents)], "doc_id long, text string")
    triples, notes = jsonld.profile_triples(flatten.flatten(df))
    rows = {(r.graph_id, r.s, r.p, r.o_iri or r.o_value, r.o_lang) for r in triples.collect()}
    return rows, {tuple(r) for r in notes.collect()}


def test_profile(spark):
    one = {
        "@context": ["http://www.w3.org/ns/odrl.jsonld", {"ex": "https://e.org/p#", "label": {"@id": "rdfs:label"}, "up": {"@id": "skos:broader", "@type": "@id"}, "when": {"@id": "ex:when", "@type": "xsd:date"}, "@language": "EN", "kind": "@type"}],
        "@graph": [
            {"@id": "ex:a", "kind": ["Action", "ex:Other"], "label": ["one", {"@value": "eins", "@language": "de"}], "up": {"@list": ["ex:b", "ex:c"]}, "when": "2026-01-01", "ex:n": [1, 2.5, True, None]},
            {"uid": "ex:b", "type": "odrl:LeftOperand", "skos:broader": "ex:a", "ex:sub": {"label": "nested"}, "ex:j": {"@value": {"x": 1}}, "rdfs:seeAlso": "page"},
        ],
    }
    e = "https://e.org/p#"
    got, notes = read(spark, one)
    assert got == {
        (0, e + "a", "rdf:type", "odrl:Action", None), (0, e + "a", "rdf:type", e + "Other", None), (0, e + "a", "rdfs:label", "one", "en"), (0, e + "a", "rdfs:label", "eins", "de"),
        (0, e + "a", "skos:broader", e + "b", None), (0, e + "a", "skos:broader", e + "c", None), (0, e + "a", e + "when", "2026-01-01", None),
        (0, e + "a", e + "n", "1", None), (0, e + "a", e + "n", "2.5", None), (0, e + "a", e + "n", "true", None),
        (0, e + "b", "rdf:type", "odrl:LeftOperand", None), (0, e + "b", "skos:broader", e + "a", None), (0, e + "b", e + "sub", "_:@graph[1].ex:sub", None), (0, "_:@graph[1].ex:sub", "rdfs:label", "nested", "en"),
    }
    assert notes == {(0, "JSON literal", e + "j"), (0, "name not expanded", "page")}


def test_edges(spark):
    based = {"@context": {"@base": "https://e.org/d/", "@vocab": "owl:", "p": "q:", "q": "https://q.org/", "short": "p:long"}, "@id": "x", "imports": "y", "short": "s", "p:z": {"@id": "q:i"}}
    loose = {"@context": "https://e.org/other", "@id": "urn:x", "name": 1, "rdfs:label": "l", "ex:y": {"@context": {"z": "urn:z"}, "@id": "urn:y"}}
    got, notes = read(spark, based, loose, None, "no json", "[]", {})
    assert got == {
        (0, "https://e.org/d/x", "owl:imports", "https://e.org/d/y", None), (0, "https://e.org/d/x", "https://q.org/long", "s", None), (0, "https://e.org/d/x", "https://q.org/z", "https://q.org/i", None),
        (1, "urn:x", "rdfs:label", "l", None), (1, "urn:x", "ex:y", "urn:y", None),
    }
    assert notes == {(1, "key not expanded", "name"), (1, "context not fetched", "https://e.org/other"), (1, "context below the root", "ex:y.@context")}


def test_hints_of_a_profile_feed_an_overlay(spark):
    """The namespace of hints is a parameter: what comes out is read as overlays are."""
    doc = {
        "@context": {"h": "https://e.org/hints#", "ex": "https://e.org/p#", "odrl": "http://www.w3.org/ns/odrl/2/"},
        "@id": "ex:size", "h:rightOperand": ["ex:small", {"@id": "ex:large"}], "h:operator": "odrl:eq", "h:datatype": "http://www.w3.org/2001/XMLSchema#string", "h:closed": True, "h:odd": "ex:x",
    }
    df = spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, text string")
    triples, _ = jsonld.profile_triples(flatten.flatten(df), "https://e.org/hints#")
    lists, facts, notes = shapes.read_overlay(triples)
    assert {(r.left_iri, r.facet, r.value) for r in lists.collect()} == {
        ("https://e.org/p#size", "values", "https://e.org/p#small"), ("https://e.org/p#size", "values", "https://e.org/p#large"), ("https://e.org/p#size", "operators", "odrl:eq")
    }
    assert [(r.left_iri, r.datatype, r.closed, r.plural, r.values_exact) for r in facts.collect()] == [("https://e.org/p#size", "xsd:string", True, False, True)]
    assert [(r.note, r.about) for r in notes.collect()] == [("property not read", "prose:odd")]
    plain, _ = jsonld.profile_triples(flatten.flatten(df))
    assert plain.where("p like 'prose:%'").count() == 0
