"""Shapes and overlays from triples: which values, operators, units and terms a graph allows, and what of it is not read.

``triples``: graph_id, seq, s, p, o_iri, o_value; ``seq`` is the place in the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.operators.hints import PATTERN_CHARS
from clausework.operators.lists import walk_lists
from clausework.operators.profiles import skipped_shapes, union_facets
from clausework.sources.shared import cut

#: Values that one property of a node may have, and terms (and cells of a list) that one graph may have.
VALUES_PER_KEY, MAX_TERMS = 256, 20_000

# The paths that are read, and what their lists close.
CONSTRAINT_LISTS = {"odrl:operator": "operators", "odrl:unit": "units"}
POLICY_LISTS = {"odrl:action": "actions", "odrl:leftOperand": "left_operands"}
CHECKS = ("datatype", "pattern", "min_inclusive", "max_inclusive")
OVERLAY_LISTS = {"prose:operator": "operators", "prose:rightOperand": "values", "prose:unit": "units"}
OVERLAY_PROPERTIES = (*OVERLAY_LISTS, "prose:datatype", "prose:closed", "prose:plural")

_FACET_KEY = ("graph_id", "left_iri", "facet")


def _property_shapes(triples: DataFrame, skipped: DataFrame) -> DataFrame:
    """graph_id, s, prop, node_at, prop_at, path, left_iri, n_left: property shapes that are read, with what their node selects.

    A property shape that no node has stands for itself (``s`` is ``prop``).
    """
    places = triples.groupBy("graph_id", "s").agg(F.min("seq").alias("node_at"))
    linked = triples.where("p = 'sh:property' and o_iri is not null").groupBy("graph_id", "s", F.col("o_iri").alias("prop")).agg(F.min("seq").alias("prop_at"))
    stated = triples.where("p = 'sh:path'").groupBy("graph_id", F.col("s").alias("prop"))
    paths = stated.agg(F.min(F.when(F.col("o_iri").isNotNull(), F.struct("seq", "o_iri")))["o_iri"].alias("path"))
    nodes, owned = linked.select("graph_id", "s").distinct(), linked.select("graph_id", "prop").distinct()
    alone = paths.join(owned, ["graph_id", "prop"], "left_anti").select("graph_id", F.col("prop").alias("s"), "prop", F.lit(0).cast("long").alias("prop_at")).join(nodes, ["graph_id", "s"], "left_anti")
    placed = linked.unionByName(alone).join(skipped, ["graph_id", "s"], "left_anti").join(places, ["graph_id", "s"]).join(paths, ["graph_id", "prop"], "left")
    selected = triples.where("p = 'sh:hasValue' and o_iri is not null").select("graph_id", F.col("s").alias("prop"), F.col("o_iri").alias("left")).distinct()
    chosen = (
        placed.where("path = 'odrl:leftOperand' and s <> prop").join(selected, ["graph_id", "prop"])
        .groupBy("graph_id", "s").agg(F.count_distinct("left").alias("n_left"), F.min("left").alias("left_iri"))
    )
    return placed.join(chosen.withColumn("left_iri", F.when(F.col("n_left") == 1, F.col("left_iri"))), ["graph_id", "s"], "left")


def _list_items(triples: DataFrame) -> DataFrame:
    """graph_id, prop, kind (iri, literal), value, at, far: what every ``sh:in`` lists, each value once; far: its list is longer than is read.

    A list that many shapes share is walked once.
    """
    listed = triples.where("p = 'sh:in'").select("graph_id", F.col("s").alias("prop"), "seq", "o_iri", "o_value")
    marked = F.when(F.col("p") == "rdf:first", F.coalesce(F.concat(F.lit("<"), "o_iri"), F.concat(F.lit('"'), "o_value"))).otherwise(F.col("o_iri"))
    chains = triples.where("p in ('rdf:first', 'rdf:rest')").select("graph_id", "s", "p", marked.alias("o_iri"))
    cells = chains.where("p = 'rdf:first'").select("graph_id", F.col("s").alias("o_iri")).distinct()
    walked = listed.join(cells, ["graph_id", "o_iri"], "left_semi")
    steps = walk_lists(chains, walked.select("graph_id", F.col("o_iri").alias("start")).distinct())
    far = F.max(F.col("ix") >= MAX_TERMS)
    members = steps.groupBy("graph_id", "head", "item").agg(F.min("ix").alias("ix"), far.alias("far"))
    through = walked.select("graph_id", "prop", "seq", F.col("o_iri").alias("head")).join(members, ["graph_id", "head"]).select("graph_id", "prop", "item", "seq", "ix", "far")
    direct = listed.join(cells, ["graph_id", "o_iri"], "left_anti").where("o_iri is null or o_iri <> 'rdf:nil'")
    item = F.coalesce(F.concat(F.lit("<"), "o_iri"), F.concat(F.lit('"'), "o_value"))
    all_items = through.unionByName(direct.select("graph_id", "prop", item.alias("item"), "seq", F.lit(0).alias("ix"), F.lit(False).alias("far"))).where("not startswith(item, '<_:')")
    kind = F.when(F.col("item").startswith("<"), "iri").otherwise("literal")
    once = all_items.groupBy("graph_id", "prop", "item").agg(F.min(F.struct("seq", "ix")).alias("at"), F.max("far").alias("far"))
    return once.select("graph_id", "prop", kind.alias("kind"), F.substr("item", F.lit(2)).alias("value"), "at", "far")


def _absolute(text: Column) -> Column:
    """A string that is an IRI with a scheme and needs no prefix."""
    return text.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://|(?i:urn|did):)\S+$")


def _first(p: str, column: str) -> Column:
    """The first object of a property, in the order of the document."""
    return F.min(F.when((F.col("p") == p) & F.col(column).isNotNull(), F.struct("seq", column)))[column]


def read_shapes(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What shape graphs allow, as lists, single checks and notes.

    * lists: graph_id, left_iri, facet (values, literals, classes, operators, units; actions and left_operands
      for the whole policy, where left_iri is empty), ix, value, n_more.  Alternative shapes of one
      operand are united in the order of the document.
    * checks: graph_id, left_iri, datatype, pattern, flags, min_inclusive, max_inclusive; the first that is stated.
    * notes: graph_id, note, about: what is left out, each once.

    Shapes below ``sh:not`` and ``sh:xone`` and shapes that are switched off are not read.  A node that selects
    several operands is read for none.  A list is left out whole if it is empty, longer than is
    read, or (of operators, units, terms) names a string that is no absolute IRI.  A pattern with a flag
    other than ``i`` or longer than ``PATTERN_CHARS`` is left out.  No triples give no rows.
    """
    skipped = cut(skipped_shapes(triples), "skipped")
    shapes = cut(_property_shapes(triples, skipped), "shapes")
    off = triples.where("p = 'sh:deactivated' and trim(o_value) in ('true', '1')").select("graph_id", F.col("s").alias("prop")).distinct()
    count = lambda p: F.count(F.when(F.col("p") == p, 1))
    facts = triples.groupBy("graph_id", F.col("s").alias("prop")).agg(
        _first("sh:datatype", "o_iri").alias("datatype"), _first("sh:pattern", "o_value").alias("pattern"), _first("sh:flags", "o_value").alias("flags"),
        _first("sh:minInclusive", "o_value").alias("min_inclusive"), _first("sh:maxInclusive", "o_value").alias("max_inclusive"),
        count("sh:in").alias("n_in"), count("sh:hasValue").alias("n_has"),
        count("sh:class").alias("n_class"), count("sh:node").alias("n_node"),
    )
    items = cut(_list_items(triples), "items")
    sizes = items.groupBy("graph_id", "prop").agg(
        F.count("*").alias("n_items"), F.max("far").alias("far"), F.max((F.col("kind") == "literal") & ~_absolute(F.col("value"))).alias("bare")
    )
    told = shapes.join(off, ["graph_id", "prop"], "left_anti").join(facts, ["graph_id", "prop"]).join(sizes, ["graph_id", "prop"], "left")
    facet = F.col("path")
    right, by_left, by_policy = facet == "odrl:rightOperand", facet.isin(*CONSTRAINT_LISTS), facet.isin(*POLICY_LISTS)
    selector = (facet == "odrl:leftOperand") & (F.col("n_has") > 0)
    placed = ((right | by_left) & F.col("left_iri").isNotNull()) | (by_policy & ~selector)
    some = placed & (F.col("n_in") > 0)
    bare = some & ~right & F.coalesce("bare", F.lit(False))
    long = some & ~bare & ((F.col("n_in") > VALUES_PER_KEY) | F.coalesce("far", F.lit(False)))
    empty = some & ~bare & ~long & F.col("n_items").isNull()
    usable = some & ~bare & ~long & ~empty
    bad_pattern = right & F.col("left_iri").isNotNull() & F.col("pattern").isNotNull() & (F.coalesce("flags", F.lit("")).rlike("[^i]") | (F.length("pattern") > PATTERN_CHARS))
    flags = {"usable": usable, "bare": bare, "long": long, "empty": empty, "bad_pattern": bad_pattern}
    told = cut(told.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}), "told")
    lists = _facets(triples, told, items)
    checks, second = _checks(told)
    return lists, checks, _notes(told).unionByName(second).distinct()


def _facets(triples: DataFrame, told: DataFrame, items: DataFrame) -> DataFrame:
    """The lists of all property shapes, united by what they close."""
    at = F.struct("node_at", "prop_at", "prop")
    named = F.coalesce(*[F.when(F.col("path") == p, f) for p, f in (CONSTRAINT_LISTS | POLICY_LISTS).items()])
    of_right = F.when(F.col("kind") == "iri", "values").otherwise("literals")
    left = F.when(F.col("path").isin(*POLICY_LISTS), "").otherwise(F.col("left_iri"))
    place = F.struct((F.col("kind") != "iri").cast("int").alias("rank"), F.col("at.seq").alias("seq"), F.col("at.ix").alias("ix"))
    listed = told.where("usable").join(items, ["graph_id", "prop"]).select(
        "graph_id", left.alias("left_iri"), F.coalesce(named, of_right).alias("facet"), "value", at.alias("shape_ix"), place.alias("ix")
    )
    rank = F.when(F.col("p") == "sh:node", 1).otherwise(0)
    named_classes = triples.where("p in ('sh:class', 'sh:node') and o_iri is not null").select("graph_id", F.col("s").alias("prop"), F.col("o_iri").alias("value"), rank.alias("rank"), "seq")
    classes = told.where("path = 'odrl:rightOperand' and left_iri is not null and not usable").join(named_classes, ["graph_id", "prop"]).select(
        "graph_id", "left_iri", F.lit("classes").alias("facet"), "value", at.alias("shape_ix"), F.struct("rank", "seq", F.lit(0).alias("ix")).alias("ix")
    )
    return union_facets(listed.unionByName(classes), MAX_TERMS, _FACET_KEY)


def _checks(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first datatype, pattern and bounds of each operand, and a note where another shape says otherwise."""
    at = ("node_at", "prop_at", "prop")
    stated = told.where("path = 'odrl:rightOperand' and left_iri is not null").withColumn(
        "pattern", F.when(F.col("pattern").isNotNull() & ~F.col("bad_pattern"), F.struct("pattern", F.coalesce("flags", F.lit("")).alias("flags")))
    )
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*at, c)))[c].alias(c)
    by_left = stated.groupBy("graph_id", "left_iri")
    checks = by_left.agg(*[first(c) for c in CHECKS]).select(
        "graph_id", "left_iri", "datatype", F.col("pattern.pattern").alias("pattern"), F.col("pattern.flags").alias("flags"), "min_inclusive", "max_inclusive"
    )
    several = by_left.agg(*[(F.min(c) != F.max(c)).alias(c) for c in CHECKS])
    notes = several.select("graph_id", F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(f"second {c}")) for c in CHECKS]))).alias("note"), F.col("left_iri").alias("about"))
    return checks.where(" or ".join(f"{c} is not null" for c in CHECKS)), notes


def _notes(told: DataFrame) -> DataFrame:
    """graph_id, note, about: what property shapes say that is not read."""
    known = F.col("path").isin("odrl:rightOperand", *CONSTRAINT_LISTS, *POLICY_LISTS)
    unselected = (F.col("path") == "odrl:rightOperand") | F.col("path").isin(*CONSTRAINT_LISTS)
    cases = [
        (F.col("path").isNull(), "no path"),
        (F.col("path").isNotNull() & ~known, "path not read"),
        (F.coalesce("n_left", F.lit(0)) > 1, "several left operands"),
        (unselected & F.col("left_iri").isNull(), "no left operand"),
        (F.col("bare"), "list with a string that is no IRI"),
        (F.col("long"), "list longer than is read"),
        (F.col("empty"), "empty list"),
        ((F.col("path") == "odrl:rightOperand") & F.col("usable") & (F.col("n_class") + F.col("n_node") > 0), "class beside a list"),
        (F.col("bad_pattern"), "pattern not read"),
        ((F.col("path") == "odrl:leftOperand") & (F.col("n_in") == 0) & (F.col("n_has") == 0), "neither value nor list"),
    ]
    about = F.when(F.col("note") == "several left operands", F.col("s")).otherwise(F.col("prop"))
    told = told.withColumn("note", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(note)) for test, note in cases]))))
    return told.select("graph_id", "note", about.alias("about"))


def read_overlay(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What overlays add to terms that profiles declare, as lists, facts and notes.

    * lists: graph_id, left_iri, facet (operators, values, units), ix, value.
    * facts: graph_id, left_iri, datatype (the first), closed, plural, values_exact (a list of values is stated).
    * notes: graph_id, note, about: a type or a label, which no overlay may give, and properties that are not known.

    Blank nodes are passed over; a term with annotations but no usable one has a row of facts.
    """
    own = triples.where(F.col("p").isin(*OVERLAY_PROPERTIES) & ~F.col("s").startswith("_:")).withColumnRenamed("s", "left_iri")
    facet = reduce(lambda out, x: out.when(F.col("p") == x[0], x[1]), OVERLAY_LISTS.items(), F)
    listed = own.where("o_iri is not null").select("graph_id", "left_iri", facet.alias("facet"), F.col("o_iri").alias("value"), F.lit(0).alias("shape_ix"), F.col("seq").alias("ix")).where("facet is not null")
    lists = union_facets(listed, MAX_TERMS, _FACET_KEY).drop("n_more")
    says = lambda p: F.coalesce(F.bool_or((F.col("p") == p) & F.trim("o_value").isin("true", "1")), F.lit(False))
    facts = own.groupBy("graph_id", "left_iri").agg(
        _first("prose:datatype", "o_iri").alias("datatype"), says("prose:closed").alias("closed"), says("prose:plural").alias("plural"),
        (F.count(F.when((F.col("p") == "prose:rightOperand") & F.col("o_iri").isNotNull(), 1)) > 0).alias("values_exact"),
    )
    note = (
        F.when(F.col("p") == "rdf:type", "type")
        .when(F.col("p").rlike("^(rdfs|skos):"), "label or note")
        .when(F.col("p").startswith("prose:") & ~F.col("p").isin(*OVERLAY_PROPERTIES) & ~F.col("s").startswith("_:"), "property not read")
    )
    about = F.when(F.col("p").startswith("prose:"), F.col("p")).otherwise(F.col("s"))
    notes = triples.select("graph_id", note.alias("note"), about.alias("about")).where("note is not null").distinct()
    return lists, facts, notes
