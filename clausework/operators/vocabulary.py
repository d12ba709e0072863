"""Vocabularies from triples: texts by language, kinds, hierarchies, conflicts, comparison; IRIs compacted; near misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions.names import iri_ok
from clausework.functions.texts import character
from clausework.model import ODRL
from clausework.sources.shared import cut


def best_language(texts: DataFrame, key: list[str], languages: list[str], untagged_first: bool = False) -> DataFrame:
    """key, text: by preference the exact tag, then the tag shortened subtag by subtag, then any tag of
    its language; then English, untagged, first (ix).  With ``untagged_first``, untagged stands before
    English, and any English tag counts."""
    ranges: list[tuple[int, str, bool]] = []
    for tag in languages:
        parts = tag.lower().split("-")
        ranges += [(len(ranges) + k, "-".join(parts[: len(parts) - k]), False) for k in range(len(parts))]
        ranges.append((len(ranges), parts[0], True))
    tag = F.lower(F.coalesce("lang", F.lit("")))
    rank = F
    for i, (_, r, primary) in enumerate(ranges):
        rank = rank.when(F.substring_index(tag, "-", 1) == r if primary else tag == r, i)
    n = len(ranges)
    if untagged_first:
        rank = rank.when(tag == "", n).when(tag == "en", n + 1).when(F.substring_index(tag, "-", 1) == "en", n + 2).otherwise(n + 3)
    else:
        rank = rank.when(tag == "en", n).when(tag == "", n + 1).otherwise(n + 2)
    return texts.withColumn("rank", rank).groupBy(*key).agg(F.min_by("text", F.struct("rank", "ix")).alias("text"))


def fallback_text(texts: DataFrame, key: list[str], chain: list[str]) -> DataFrame:
    """The texts of the first property in ``chain`` that has any, for each key."""
    rank = F.array_position(F.array(*[F.lit(p) for p in chain]), F.col("p"))
    ranked = texts.withColumn("pred_rank", rank).where("pred_rank > 0")
    least = ranked.groupBy(*key).agg(F.min("pred_rank").alias("least"))
    return ranked.join(least, key).where("pred_rank = least").drop("pred_rank", "least")


# The properties that name a node, the most preferred first.
LABEL_PROPERTIES = ("rdfs:label", "skos:prefLabel", "dct:title", "schema:name")
LABEL_NAMESPACES = {
    "http://www.w3.org/2000/01/rdf-schema#": "rdfs:", "http://www.w3.org/2004/02/skos/core#": "skos:", "http://purl.org/dc/terms/": "dct:", "dcterms:": "dct:",
    "http://schema.org/": "schema:", "https://schema.org/": "schema:",
}


def label_property(p: Column) -> Column:
    """A property by its usual prefix, however it is written."""
    out = F
    for written, prefix in LABEL_NAMESPACES.items():
        out = out.when(p.startswith(written), F.concat(F.lit(prefix), F.substr(p, F.lit(len(written) + 1))))
    return out.otherwise(p)


def node_label(texts: DataFrame, key: list[str], languages: list[str]) -> DataFrame:
    """key, label: of a node's most preferred label property the best text; a node whose texts there are blank has none."""
    first = fallback_text(texts.withColumn("p", label_property(F.col("p"))), key, list(LABEL_PROPERTIES)).withColumn("text", F.trim("text")).where("text <> ''")
    return best_language(first, key, languages, untagged_first=True).withColumnRenamed("text", "label")


def descendants(edges: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """root, iri, depth: what lies below each root along edges (child, parent), each once at its least depth.

    Breadth first: a frontier is joined with the edges and what was seen is taken
    away; a search ends when it finds nothing new or at ``depth``.
    """
    seen = cut(roots.select(F.col("iri").alias("root"), "iri", F.lit(0).alias("depth")), "seen")
    frontier = seen
    for k in range(1, depth + 1):
        below = frontier.join(edges, frontier["iri"] == edges["parent"]).select("root", F.col("child").alias("iri")).distinct()
        frontier = cut(below.join(seen, ["root", "iri"], "left_anti").withColumn("depth", F.lit(k)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def derived_kinds(types: DataFrame, edges: DataFrame, roots: list[str]) -> DataFrame:
    """iri, kind: the kinds a class hierarchy gives a term (its types' roots)."""
    spark = types.sparkSession
    below = descendants(edges, spark.createDataFrame([(r,) for r in roots], "iri string"))
    direct = types.where(F.col("kind").isin(roots)).select("iri", "kind")
    through = types.join(below.select(F.col("iri").alias("kind"), "root"), "kind").select("iri", F.col("root").alias("kind"))
    return direct.unionByName(through).distinct()


def profile_summary(terms: DataFrame) -> DataFrame:
    """profile_id, kind, n."""
    return terms.groupBy("profile_id", "kind").agg(F.count("*").alias("n"))


def most_defined_by(triples: DataFrame) -> DataFrame:
    """graph_id, iri: the profile IRI most named by rdfs:isDefinedBy, the first on a tie."""
    named = triples.where("p = 'rdfs:isDefinedBy'").groupBy("graph_id", "o_iri").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return named.groupBy("graph_id").agg(F.max_by("o_iri", F.struct("n", -F.col("first"))).alias("iri"))


def profile_conflicts(terms: DataFrame) -> DataFrame:
    """iri, first_profile, other_profile: terms that two profiles declare."""
    by = terms.groupBy("iri", "profile_id").agg(F.min("load_order").alias("load_order"))
    w = Window.partitionBy("iri").orderBy("load_order")
    ranked = by.withColumn("first_profile", F.first("profile_id").over(w)).withColumn("rn", F.row_number().over(w))
    return ranked.where("rn > 1").select("iri", "first_profile", F.col("profile_id").alias("other_profile"))


def merge_vocabulary(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New entries first, then old ones whose key the new ones lack."""
    return new.withColumn("part", F.lit(0)).unionByName(old.join(new.select(key).distinct(), key, "left_anti").withColumn("part", F.lit(1)))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_in and the rows that one of two tables has more often than the other; empty if they are the same."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def compact_iris(iris: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``iris`` (iri) with compact: the longest bound namespace that leaves a plain name, the greatest prefix on a tie; ODRL's bare.

    An IRI's cut points are exploded and joined by equality with the namespaces.
    """
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.length("iri")), lambda i: F.when(F.substring("iri", i, F.lit(1)).isin("#", "/", ":"), i)), lambda i: i.isNotNull())
    cand = iris.select("iri", F.explode(cuts).alias("cut")).select(
        "iri", F.substring("iri", F.lit(1), F.col("cut")).alias("namespace"), F.substr("iri", F.col("cut") + 1).alias("rest")
    )
    hit = cand.where(F.col("rest").rlike("^[A-Za-z0-9_.-]+$")).join(prefixes.select("prefix", "namespace"), "namespace")
    best = hit.groupBy("iri").agg(F.max(F.struct(F.length("namespace").alias("n"), "prefix", "rest")).alias("b"))
    compact = F.when(F.col("iri").startswith(ODRL), F.substr("iri", F.lit(len(ODRL) + 1))).otherwise(F.concat("b.prefix", F.lit(":"), F.col("b.rest")))
    return iris.join(best, "iri", "left").select("iri", compact.alias("compact"))


def nearest_term(typed: DataFrame, candidates: DataFrame) -> DataFrame:
    """written, candidate, distance: the nearest candidate (name, ix) within a third of the length, the earlier on a tie.

    Distinct typed terms meet only candidates of a near enough length: an
    equi-join on the length, not a product.
    """
    limit = F.greatest(F.lit(1), F.floor((F.length("written") + 1) / 3).cast("int"))
    words = typed.select("written").distinct().where(F.length("written").between(2, 64)).withColumn("limit", limit)
    near = words.withColumn("size", F.explode(F.sequence(F.length("written") - F.col("limit"), F.length("written") + F.col("limit"))))
    met = near.join(candidates.withColumn("size", F.length("name")), "size")
    distance = F.levenshtein("written", "name", 64)
    scored = met.withColumn("distance", distance).where((F.col("distance") <= F.col("limit")) & (F.col("distance") < F.length("written")))
    return scored.groupBy("written").agg(F.min(F.struct("distance", "ix", "name")).alias("b")).select("written", F.col("b.name").alias("candidate"), F.col("b.distance").alias("distance"))


def declared_labels(labels: DataFrame) -> DataFrame:
    """doc_id, iri, label without labels that two identifiers of a document share."""
    owners = labels.groupBy("doc_id", "label").agg(F.min("iri").alias("a"), F.max("iri").alias("b")).where("a = b").select("doc_id", "label")
    return labels.join(owners, ["doc_id", "label"]).groupBy("doc_id", "iri").agg(F.min_by("label", "ix").alias("label"))


def resolve_references(nodes: DataFrame, rounds: int = 12) -> DataFrame:
    """doc_id, id, target: where following references (ref, null at a declaration) ends: at a declaration, or at the
    identifier that the document does not declare; null for a circle.

    Pointers are doubled: 2**rounds references are followed at most.
    """
    ids = nodes.select("doc_id", F.col("id").alias("ref")).distinct().withColumn("declared", F.lit(True))
    known = nodes.join(ids, ["doc_id", "ref"], "left")
    at = cut(known.select("doc_id", "id", F.coalesce("ref", "id").alias("to"), F.col("declared").isNull().alias("done")), "refs")
    for _ in range(rounds):
        further = at.select("doc_id", F.col("id").alias("to"), F.col("to").alias("next"), F.col("done").alias("next_done"))
        at = cut(
            at.join(further, ["doc_id", "to"], "left").select(
                "doc_id", "id", F.when(F.col("done"), F.col("to")).otherwise(F.coalesce("next", "to")).alias("to"), (F.col("done") | F.coalesce("next_done", F.lit(False))).alias("done")
            ),
            "refs",
        )
        if at.where("not done").isEmpty():
            break
    return at.select("doc_id", "id", F.when(F.col("done"), F.col("to")).alias("target"))


# What stands behind a backslash in N-Triples.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: Column) -> Column:
    """Escapes of N-Triples decoded once, from left to right; what is none stays as written."""
    pieces = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"), F.lit(0))
    named = F.create_map(*[F.lit(x) for k, v in ESCAPES.items() for x in (f"\\{k}", v)])

    def decoded(piece: Column) -> Column:
        code = F.when(piece.rlike(r"^\\[uU].{4}"), F.conv(F.substr(piece, F.lit(3)), 16, 10).cast("long"))
        return F.coalesce(named[piece], character(code), piece)

    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("\\"), decoded(p)).otherwise(p)), "")


def read_ntriples(lines: DataFrame) -> DataFrame:
    """s, p, o_iri, o_value, o_lang, o_datatype from lines (value) of N-Triples; what is no triple, or has an IRI that none is, is dropped."""
    pattern = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'
    group = lambda i: F.regexp_extract("value", pattern, i)
    some = lambda c: F.when(c != "", c)
    iri = lambda i: some(unescape(group(i)))
    o_iri = F.coalesce(iri(4), some(group(5)))
    out = lines.where(F.col("value").rlike(pattern)).select(
        F.coalesce(iri(1), group(2)).alias("s"), F.coalesce(iri(3), F.lit("")).alias("p"), o_iri.alias("o_iri"),
        F.when(o_iri.isNull(), unescape(group(6))).alias("o_value"), some(group(7)).alias("o_lang"), iri(8).alias("o_datatype"),
    )
    return out.where(iri_ok(F.col("s")) & iri_ok(F.col("p")) & (F.col("o_iri").isNull() | iri_ok(F.col("o_iri"))))


def classify_text(text: Column) -> Column:
    """What a profile's text is before it is read: empty, html, rdf-xml, json-schema, context-only, policy, json, other."""
    t = F.ltrim(text)
    keys = F.json_object_keys(t)
    is_json = t.startswith("{") & keys.isNotNull()
    has = lambda *names: F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(text.isNull() | (t == ""), "empty")
        .when(F.lower(F.substring(t, 1, 15)).rlike("^<(!doctype html|html)"), "html")
        .when(t.startswith("<?xml") | t.contains("<rdf:RDF"), "rdf-xml")
        .when(is_json & has("$schema"), "json-schema")
        .when(is_json & (F.size(keys) == 1) & has("@context"), "context-only")
        .when(is_json & has("permission", "prohibition", "obligation"), "policy")
        .when(is_json, "json")
        .otherwise("other")
    )
