"""Profiles as JSON-LD read as triples: names expand by joins with the definitions of their document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions.wording import resolve_iri
from clausework.model import ODRL, XSD
from clausework.operators.lists import resolve_aliases
from clausework.operators.rewrite import KNOWN_CONTEXTS
from clausework.sources.shared import cut

# Prefixes that need no declaration, and those that the ODRL context adds.
WELL_KNOWN = {
    "dct": "http://purl.org/dc/terms/",
    "dcterms": "http://purl.org/dc/terms/",
    "odrl": ODRL,
    "owl": "http://www.w3.org/2002/07/owl#",
    "prof": "http://www.w3.org/ns/dx/prof/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "xsd": XSD,
}
OF_ODRL_CONTEXT = {
    "cc": "http://creativecommons.org/ns#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "schema": "http://schema.org/",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
}
# Properties whose strings are IRIs.
IRI_VALUED = (
    "odrl:includedIn", "odrl:implies", "owl:equivalentClass", "owl:equivalentProperty", "owl:imports", "owl:sameAs", "prof:isProfileOf", "rdf:type",
    "rdfs:domain", "rdfs:isDefinedBy", "rdfs:range", "rdfs:seeAlso", "rdfs:subClassOf", "rdfs:subPropertyOf", "sh:class", "sh:datatype", "sh:node", "sh:path", "sh:targetClass", "sh:targetNode",
    "skos:broader", "skos:closeMatch", "skos:exactMatch", "skos:inScheme", "skos:member", "skos:narrower",
)
#: Shown short in triples, as all operators on triples expect.
SHORT = {p: n for p, n in WELL_KNOWN.items() if p != "dcterms"} | {"sh": "http://www.w3.org/ns/shacl#"}
#: What stands between a property and its values.
NESTED = r"(?:\[[0-9]+\]|\.@list|\.@set)*$"


def _table(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


#: The prefix that operators on triples know hints by, and the hints that are no IRIs.
HINTS, FLAGS = "prose:", ("prose:closed", "prose:plural")


def short(iri: Column, hints: str | None = None) -> Column:
    """An IRI of a known namespace by its prefix; ``hints`` is the namespace of hints, where there is one."""
    out = F
    for prefix, namespace in (SHORT | ({HINTS[:-1]: hints} if hints else {})).items():
        out = out.when(iri.startswith(namespace), F.concat(F.lit(prefix + ":"), F.substr(iri, F.lit(len(namespace) + 1))))
    return out.otherwise(iri)


def _contexts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the context at the root of each document says: terms (doc_id, term, iri, coerce) and settings (doc_id, vocab, base, language, odrl)."""
    at_root = r"^@context(\[[0-9]+\])?$"
    direct = rows.where(F.col("parent").rlike(at_root) & (F.col("kind") != "list") & ~F.col("path").rlike(r"^@context\[[0-9]+\]$"))
    named = direct.where("not startswith(key, '@')")
    parts = rows.where("key in ('@id', '@type', '@reverse')").groupBy("doc_id", F.col("parent").alias("path")).agg(
        *[F.max(F.when(F.col("key") == k, F.coalesce("value", F.lit("")))).alias(n) for k, n in (("@id", "id"), ("@type", "coerce"), ("@reverse", "back"))]
    )
    told = named.join(parts, ["doc_id", "path"], "left").where("kind in ('string', 'object', 'null') and back is null")
    iri = F.when(F.col("kind") == "string", F.col("value")).when(F.col("kind") == "object", F.coalesce("id", "key"))
    last = told.groupBy("doc_id", "key").agg(F.max(F.struct("seq", iri.alias("iri"), "coerce")).alias("said")).select("doc_id", "key", "said.iri", "said.coerce").where("iri is not null")
    chained = resolve_aliases(last.select("doc_id", "key", "iri"))
    setting = lambda k: F.max(F.when(F.col("key") == k, F.struct("seq", "value")))["value"]
    remote = F.col("path").rlike(at_root) & (F.col("kind") == "string")
    odrl = F.coalesce(F.bool_or(remote & F.regexp_replace("value", "/+$", "").isin(*KNOWN_CONTEXTS)), F.lit(False))
    settings = rows.where(F.col("path").rlike(r"^@context")).groupBy("doc_id").agg(
        setting("@vocab").alias("vocab"), setting("@base").alias("base"), F.lower(setting("@language")).alias("language"), odrl.alias("odrl")
    )
    return chained.join(last.select("doc_id", "key", "coerce"), ["doc_id", "key"]).withColumnRenamed("key", "term"), settings


def _spellings(texts: DataFrame, terms: DataFrame, settings: DataFrame) -> DataFrame:
    """doc_id, text, as_term, as_iri, keyword, coerce: what each distinct name of a document stands for, as a key or type and as a value."""
    head, rest = F.substring_index("text", ":", 1), F.expr("substring(text, instr(text, ':') + 1)")
    own = terms.select("doc_id", F.col("term").alias("text"), F.col("iri").alias("own"), "coerce")
    by = terms.select("doc_id", F.col("term").alias("head"), F.col("iri").alias("namespace"))
    wide = texts.distinct().withColumn("head", head).join(own, ["doc_id", "text"], "left").join(by, ["doc_id", "head"], "left").join(settings, "doc_id", "left")
    odrl = F.coalesce("odrl", F.lit(False))

    def prefixed(text: Column, first: Column, tail: Column, bound: Column) -> Column:
        known = F.coalesce(_table(WELL_KNOWN)[first], F.when(odrl, _table(OF_ODRL_CONTEXT)[first]))
        whole = (first == "_") | tail.startswith("//")
        return F.when(whole, text).when(bound.isNotNull() & ~bound.startswith("@"), F.concat(bound, tail)).otherwise(F.coalesce(F.concat(known, tail), text))

    none = F.lit(None).cast("string")

    def full(name: Column) -> Column:
        return prefixed(name, F.substring_index(name, ":", 1), F.substr(name, F.instr(name, ":") + 1), none)

    vocab = full(F.col("vocab"))
    bare = F.when(F.col("vocab").isNotNull(), F.concat(vocab, "text")).when(odrl, F.concat(F.lit(ODRL), "text"))
    based = F.when(F.col("base").isNotNull(), resolve_iri(F.col("base"), F.col("text")))
    colon = F.col("text").contains(":")
    defined = F.when(F.col("own").contains(":"), full(F.col("own"))).otherwise(F.coalesce(F.when(F.col("vocab").isNotNull(), F.concat(vocab, "own")), F.when(odrl, F.concat(F.lit(ODRL), "own"))))
    compact = prefixed(F.col("text"), F.col("head"), rest, full(F.col("namespace")))
    keyword = (
        F.when(F.col("text").startswith("@"), F.col("text")).when(F.col("own").startswith("@"), F.col("own"))
        .when(F.col("own").isNull() & odrl & (F.col("text") == "uid"), "@id").when(F.col("own").isNull() & odrl & (F.col("text") == "type"), "@type")
    )
    return wide.select(
        "doc_id", "text", F.coalesce(F.when(~F.col("own").startswith("@"), defined), F.when(colon, compact), bare, based).alias("as_term"),
        F.when(colon, compact).otherwise(based).alias("as_iri"), keyword.alias("keyword"), "coerce", "language",
    )


def profile_triples(rows: DataFrame, hints: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Triples (graph_id, seq, s, p, o_iri, o_value, o_lang) and notes (graph_id, note, about) of flattened JSON-LD documents.

    Prefixes, other terms, ``@vocab``, ``@base``, ``@language``, coerced types, ``@list`` and ``@set``, value objects, nested
    nodes and ``@graph`` are read as the context at the root of the document says; known
    namespaces are written short.  A node without an identifier is named by its path.  Names in properties that hold
    IRIs need no ``@id``.  Null values say nothing; text that is no JSON has no rows.  ``hints`` is the namespace in
    which these profiles annotate terms: its properties come out as overlays are read, and but for flags their
    strings are IRIs.

    Not followed, each with a note: contexts by reference (but ODRL's own), contexts below the root, keys and
    types that nothing expands, relative IRIs without a base, JSON literals.  An empty ``@list`` gives no triple.
    """
    rows = cut(rows, "rows")
    terms, settings = _contexts(rows)
    inside = F.col("path").rlike(r"(^|[.])@context($|[.\[])")
    data = F.col("path").rlike(r"(^|[.])@value[.\[]")
    body = rows.where(~inside & ~data & (F.col("kind") != "error"))
    texts = body.where("key is not null").select("doc_id", F.col("key").alias("text")).unionByName(body.where("kind = 'string'").select("doc_id", F.col("value").alias("text")))
    names = cut(_spellings(texts, cut(terms, "terms"), settings), "names")
    keyed = names.select("doc_id", F.col("text").alias("key"), F.col("as_term").alias("prop"), "keyword", "coerce", "language")
    members = cut(body.where("key is not null").join(keyed, ["doc_id", "key"]), "members")

    said = lambda k, c: F.max(F.when(F.col("keyword") == k, F.col(c)))
    facts = members.groupBy("doc_id", F.col("parent").alias("path")).agg(
        said("@value", "kind").alias("v_kind"), said("@value", "value").alias("v_text"), said("@language", "value").alias("v_lang"),
        F.min(F.when((F.col("keyword") == "@id") & (F.col("kind") == "string"), F.col("value"))).alias("id"), F.bool_or(F.col("keyword").isin("@list", "@set")).alias("wraps"),
    )
    objects = body.where("kind = 'object'").select("doc_id", "path").join(facts, ["doc_id", "path"], "left")
    ids = names.select("doc_id", F.col("text").alias("id"), F.col("as_iri").alias("id_iri"))
    nodes = objects.where("v_kind is null and not coalesce(wraps, false)").join(ids, ["doc_id", "id"], "left")
    subjects = cut(nodes.select("doc_id", "path", F.when(F.col("id").isNotNull(), F.col("id_iri")).otherwise(F.concat(F.lit("_:"), "path")).alias("s"), "id"), "subjects")

    leaves = body.where("kind not in ('list', 'null') and path <> ''").select("doc_id", "path", "kind", "value", "seq", F.regexp_replace("path", NESTED, "").alias("at"))
    values = objects.where("v_kind is not null").select("doc_id", "path", "v_kind", "v_text", "v_lang")
    targets = subjects.select("doc_id", "path", F.col("s").alias("o_node"))
    meant = names.select("doc_id", F.col("text").alias("value"), "as_term", "as_iri")
    props = members.select("doc_id", F.col("path").alias("at"), F.col("parent").alias("owner"), "prop", "keyword", "coerce", "language")
    owners = subjects.select("doc_id", F.col("path").alias("owner"), "s")
    wide = (
        leaves.join(props.where("keyword is null or keyword = '@type'"), ["doc_id", "at"]).join(owners, ["doc_id", "owner"])
        .join(values, ["doc_id", "path"], "left").join(targets, ["doc_id", "path"], "left").join(meant, ["doc_id", "value"], "left")
    )
    is_type, text = F.col("keyword") == "@type", F.col("kind") == "string"
    p = F.when(is_type, "rdf:type").otherwise(short(F.col("prop"), hints))
    holds_iri = p.isin(*IRI_VALUED) | (p.startswith(HINTS) & ~p.isin(*FLAGS)) if hints else p.isin(*IRI_VALUED)
    coerce = F.col("coerce")
    iri = (
        F.when(F.col("kind") == "object", F.col("o_node")).when(~text, None).when(is_type, F.col("as_term"))
        .when(coerce == "@vocab", F.col("as_term")).when((coerce == "@id") | (coerce.isNull() & holds_iri), F.col("as_iri"))
    )
    names_iri = is_type | coerce.isin("@id", "@vocab") | (coerce.isNull() & holds_iri)
    literal = F.when(F.col("v_kind").isin("string", "number", "boolean"), F.col("v_text")).when((F.col("kind") != "object") & ~(text & F.coalesce(names_iri, F.lit(False))), F.col("value"))
    lang = F.when(F.col("v_kind").isNotNull(), F.lower("v_lang")).when(text & coerce.isNull(), F.col("language"))
    told = wide.where(is_type.isNull() | ~is_type | text).select(
        F.col("doc_id").alias("graph_id"), "seq", "s", p.alias("p"), short(iri, hints).alias("o_iri"), literal.alias("o_value"), F.when(literal.isNotNull(), lang).alias("o_lang"), "value", "v_kind", "kind"
    )
    told = cut(told, "told")
    whole = F.col("s").isNotNull() & F.col("p").isNotNull() & (F.col("o_iri").isNotNull() | F.col("o_value").isNotNull())
    note = lambda df, n, about: df.select(F.col("doc_id").alias("graph_id"), F.lit(n).alias("note"), F.col(about).alias("about"))
    relative = told.where(F.col("p").isNotNull() & F.col("o_iri").isNull() & F.col("o_value").isNull() & (F.col("kind") == "string"))
    notes = (
        note(members.where("keyword is null and prop is null"), "key not expanded", "key")
        .unionByName(relative.select("graph_id", F.lit("name not expanded").alias("note"), F.col("value").alias("about")))
        .unionByName(note(subjects.where("s is null"), "name not expanded", "id"))
        .unionByName(told.where("v_kind in ('object', 'list')").select("graph_id", F.lit("JSON literal").alias("note"), F.col("p").alias("about")))
        .unionByName(note(rows.where(F.col("path").rlike(r"^@context(\[[0-9]+\])?$") & (F.col("kind") == "string") & ~F.regexp_replace("value", "/+$", "").isin(*KNOWN_CONTEXTS)), "context not fetched", "value"))
        .unionByName(note(rows.where((F.col("key") == "@context") & F.col("path").rlike(r"[.]@context$")), "context below the root", "path"))
    )
    return told.where(whole).select("graph_id", "seq", "s", "p", "o_iri", "o_value", "o_lang"), notes.distinct()
