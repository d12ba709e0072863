"""Profiles and shapes from triples: headers, trimmed vocabularies, skipped shapes, united and compared lists.

``triples``: graph_id, seq, s, p, o_iri, o_value, o_lang; ``seq`` is the place in the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions.texts import plain
from clausework.operators.vocabulary import best_language, fallback_text
from clausework.sources.shared import cut

# What is kept of a published vocabulary.
HEADER_CLASSES = ("owl:Ontology", "prof:Profile", "odrl:Profile")
TERM_KINDS = ("odrl:Action", "odrl:ConflictTerm", "odrl:LeftOperand", "odrl:Operator", "odrl:RightOperand")
TERM_PROPERTIES = (
    "rdfs:label", "skos:definition", "skos:note", "odrl:includedIn", "odrl:implies", "skos:broader", "skos:exactMatch", "owl:deprecated",
)
ONTOLOGY_PROPERTIES = ("rdfs:label", "dct:description", "owl:versionInfo", "dct:license", "dct:creator", "dct:contributor")
TITLES = ("rdfs:label", "skos:prefLabel", "dct:title")
DESCRIPTIONS = ("skos:definition", "rdfs:comment", "dct:description")
VERSIONS = ("owl:versionInfo", "dct:hasVersion")
IMPORTS = ("owl:imports", "prof:isProfileOf")
#: Characters of a label and of a longer text that are kept.
LABEL_CHARS, TEXT_CHARS = 200, 4000


def header_nodes(triples: DataFrame) -> DataFrame:
    """graph_id, s: the first subject of a graph that is typed as an ontology or a profile."""
    typed = triples.where((F.col("p") == "rdf:type") & F.col("o_iri").isin(*HEADER_CLASSES)).select("graph_id", "s").distinct()
    places = triples.groupBy("graph_id", "s").agg(F.min("seq").alias("seq"))
    return typed.join(places, ["graph_id", "s"]).groupBy("graph_id").agg(F.min_by("s", F.struct("seq", "s")).alias("s"))


def most_defined_by(triples: DataFrame) -> DataFrame:
    """graph_id, by: what most terms of a graph say they are defined by; of equals the one that is met first, subject by subject."""
    places = triples.groupBy("graph_id", "s").agg(F.min("seq").alias("place"))
    said = triples.where("p = 'rdfs:isDefinedBy' and o_iri is not null and not startswith(o_iri, '_:')").join(places, ["graph_id", "s"])
    counts = said.groupBy("graph_id", F.col("o_iri").alias("by")).agg(F.count("*").alias("n"), F.min(F.struct("place", "seq")).alias("at"))
    return counts.groupBy("graph_id").agg(F.min_by("by", F.struct(-F.col("n"), F.col("at"))).alias("by"))


def profile_headers(triples: DataFrame, languages: list[str]) -> DataFrame:
    """graph_id, iri, title, description, version, imports of every graph.

    ``iri`` is the header's, else what most of the graph's terms say they are defined by;
    a blank node gives texts but no IRI.  Texts are plain, blank ones count for nothing.
    Imports stand in the order of the document, each once, without blank nodes.
    """
    found = triples.select("graph_id").distinct().join(header_nodes(triples), "graph_id", "left").join(most_defined_by(triples), "graph_id", "left")
    named = F.when(~F.col("s").startswith("_:"), F.col("s"))
    heads = found.select("graph_id", F.coalesce(named, "by").alias("iri"), F.coalesce("s", "by").alias("s"))
    stated = triples.join(heads.select("graph_id", "s"), ["graph_id", "s"])
    texts = stated.where("o_value is not null").select("graph_id", "p", F.col("o_value").alias("raw"), F.col("o_lang").alias("lang"), F.col("seq").alias("ix"))

    def best(chain: tuple[str, ...], most: int, name: str) -> DataFrame:
        shown = texts.where(F.col("p").isin(*chain)).withColumn("text", plain(F.col("raw"), most)).where("text <> ''")
        return best_language(fallback_text(shown, ["graph_id"], list(chain)), ["graph_id"], languages).withColumnRenamed("text", name)

    version = fallback_text(texts, ["graph_id"], list(VERSIONS)).groupBy("graph_id").agg(plain(F.min_by("raw", "ix"), LABEL_CHARS).alias("version"))
    rank = F.array_position(F.array(*[F.lit(p) for p in IMPORTS]), F.col("p"))
    imported = (
        stated.where(F.col("p").isin(*IMPORTS) & ~F.col("o_iri").startswith("_:"))
        .groupBy("graph_id", "o_iri").agg(F.min(F.struct(rank.alias("rank"), F.col("seq").alias("seq"))).alias("at"))
        .groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("at", "o_iri"))).alias("found"))
        .select("graph_id", F.col("found.o_iri").alias("imports"))
    )
    parts = (best(TITLES, LABEL_CHARS, "title"), best(DESCRIPTIONS, TEXT_CHARS, "description"), version, imported)
    out = reduce(lambda a, b: a.join(b, "graph_id", "left"), parts, heads)
    return out.select("graph_id", "iri", "title", "description", "version", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))


def trim_vocabulary(triples: DataFrame) -> DataFrame:
    """Triples of the terms and properties that are read; a graph whose ontology states no licence is left out whole."""
    types = triples.where("p = 'rdf:type'")
    ontologies = types.where("o_iri = 'owl:Ontology'").select("graph_id", "s").distinct()
    terms = types.where(F.col("o_iri").isin(*TERM_KINDS)).select("graph_id", "s").distinct().join(ontologies, ["graph_id", "s"], "left_anti")
    kept_terms = F.col("p").isin(*TERM_PROPERTIES) | ((F.col("p") == "rdf:type") & F.col("o_iri").isin(*TERM_KINDS))
    kept_heads = F.col("p").isin("rdf:type", *ONTOLOGY_PROPERTIES)
    kept = triples.where(kept_terms).join(terms, ["graph_id", "s"], "left_semi").unionByName(triples.where(kept_heads).join(ontologies, ["graph_id", "s"], "left_semi"))
    licensed = triples.where("p = 'dct:license'").join(ontologies, ["graph_id", "s"], "left_semi").select("graph_id").distinct()
    return kept.join(licensed, "graph_id", "left_semi")


def skipped_shapes(triples: DataFrame) -> DataFrame:
    """graph_id, s: nodes under ``sh:not`` and ``sh:xone`` with all they lead to, and shapes that are switched off.

    Breadth first from all graphs at once; a round's finds are written, and only
    whether there are any reaches the driver.  What a switched-off shape leads to stays.
    """
    iris = triples.where("o_iri is not null")
    steps = cut(iris.where("startswith(p, 'sh:') or p in ('rdf:first', 'rdf:rest')").select("graph_id", "s", F.col("o_iri").alias("to")).distinct(), "steps")
    frontier = cut(iris.where("p in ('sh:not', 'sh:xone')").select("graph_id", F.col("o_iri").alias("s")).distinct(), "skipped")
    seen = frontier
    while not frontier.isEmpty():
        reached = frontier.join(steps, ["graph_id", "s"]).select("graph_id", F.col("to").alias("s")).distinct()
        frontier = cut(reached.join(seen, ["graph_id", "s"], "left_anti"), "skipped")
        seen = seen.unionByName(frontier)
    off = triples.where("p = 'sh:deactivated' and trim(o_value) in ('true', '1')").select("graph_id", "s")
    return seen.unionByName(off).distinct()


def union_facets(items: DataFrame, most: int = 256, key: tuple[str, ...] = ("left_iri", "facet")) -> DataFrame:
    """key, ix, value, n_more: the values of alternative shapes (shape_ix, ix) together, each at its first place.

    ``most`` values stay in a list, as a profile's limit says; ``n_more`` counts what is beyond.
    """
    first = items.groupBy(*key, "value").agg(F.min(F.struct("shape_ix", "ix")).alias("at"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("at", "value")) - 1
    total = first.groupBy(*key).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("n_more"))
    return first.withColumn("ix", place).where(F.col("ix") < most).join(total, list(key)).select(*key, "ix", "value", "n_more")


def same_shapes(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_in, left_iri, facet, value: list entries (left_iri, facet, value) that one of two shape graphs has alone; none if they are the same.

    Lists are sets: order and repeats say nothing.
    """
    columns = ["left_iri", "facet", "value"]
    mine, theirs = a.select(*columns), b.select(*columns)
    return (
        mine.withColumn("side", F.lit("a")).unionByName(theirs.withColumn("side", F.lit("b")))
        .groupBy(*columns).agg(F.collect_set("side").alias("sides"))
        .where("size(sides) = 1").select(F.get("sides", F.lit(0)).alias("only_in"), *columns)
    )


def widened_values(host: DataFrame, base: DataFrame) -> DataFrame:
    """left_iri, value: what a closed host list allows that the lists below it did not; operands without a list below are not widened."""
    listed = base.select("left_iri").distinct()
    return host.select("left_iri", "value").distinct().join(listed, "left_iri", "left_semi").join(base.select("left_iri", "value"), ["left_iri", "value"], "left_anti")


def picker_order(nodes: DataFrame, terms: DataFrame, builtins: DataFrame) -> DataFrame:
    """iri, label, path: what a picker offers, built-in entries first, then a profile's, depth first.

    ``nodes`` (iri, path) are places in the action tree, ``terms`` (iri, label, deprecated) what profiles declare;
    a deprecated term and one that is built in are left out, a term met twice keeps its first place.
    """
    first = nodes.groupBy("iri").agg(F.min("path").alias("path"))
    offered = terms.where("not deprecated").join(builtins.select("iri"), "iri", "left_anti").join(first, "iri")
    own = builtins.select("iri", "label", F.lit(0).alias("grp"), F.array("iri").alias("path"))
    return own.unionByName(offered.select("iri", "label", F.lit(1).alias("grp"), "path"))
