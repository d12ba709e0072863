"""Checks and rewrites on flattened rows: keys, kinds, scope, limits, the edit log."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions.names import local_name
from clausework.model import ODRL
from clausework.sources.shared import cut

# What makes a node a policy, what a policy node may hold, and prefixes of descriptions.
POLICY_CLASSES = "Set Offer Agreement Request Ticket Privacy Assertion Policy".split()
RULE_KEYS = "permission prohibition obligation".split()
KNOWN_KEYS = (
    "@context @type @id type id uid profile conflict inheritFrom assigner assignee target action timestamp summary constraint duty remedy "
    "consequence refinement and or xone andSequence leftOperand operator rightOperand rightOperandReference unit dataType source partOf"
).split() + RULE_KEYS
DESCRIPTIVE = ("dc:", "dct:", "dcterms:", "rdfs:", "skos:", "schema:")


def is_policy(types: Column, keys: Column) -> Column:
    """A type with a policy class's name, or a key of a rule list."""
    return F.exists(types, lambda t: local_name(t).isin(POLICY_CLASSES)) | F.arrays_overlap(F.transform(keys, local_name), F.array(*[F.lit(k) for k in RULE_KEYS]))


def is_constraint(types: Column, keys: Column) -> Column:
    named = F.exists(types, lambda t: local_name(t).isin("Constraint", "LogicalConstraint"))
    return named | F.arrays_overlap(F.transform(keys, local_name), F.array(*[F.lit(k) for k in ("leftOperand", "and", "or", "xone", "andSequence")]))


def policy_kind(types: Column) -> Column:
    """The first type that is not Policy, else Set."""
    return F.coalesce(F.get(F.filter(F.transform(types, local_name), lambda t: t != "Policy"), F.lit(0)), F.lit("Set"))


def normalise_keys(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, parent, key, pos) with bare, and kept: of the spellings of one key in one node the bare one wins, else the first."""
    bare = F.when(F.col("key").startswith("odrl:") | F.col("key").startswith(ODRL), local_name(F.col("key"))).otherwise(F.col("key"))
    w = Window.partitionBy("doc_id", "parent", "bare").orderBy((F.col("key") != F.col("bare")).cast("int"), "pos")
    return rows.withColumn("bare", bare).withColumn("kept", F.row_number().over(w) == 1)


def unknown_keys(rows: DataFrame) -> DataFrame:
    """doc_id, path, key of members that are neither known nor descriptive."""
    described = [F.col("key").startswith(p) for p in DESCRIPTIVE]
    test = described[0]
    for d in described[1:]:
        test = test | d
    return rows.where(F.col("key").isNotNull() & ~test & ~local_name(F.col("key")).isin(KNOWN_KEYS)).select("doc_id", "path", "key")


def strip_out_of_scope(rows: DataFrame, gone: list[str]) -> DataFrame:
    """Rows without the members named in ``gone`` and all that lies below them.

    Nodes are intervals of places in their document (``seq``, ``last``), and intervals nest: a row goes if a
    member named so, itself or before it, reaches so far.  One sorted pass over rows that are read once.
    """
    named = local_name(F.col("key")).isin(gone) & F.col("parent").isNotNull()
    upto = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("until").over(upto)
    placed = rows.withColumn("until", F.when(named, F.col("last"))).withColumn("reach", reach)
    return placed.where(F.coalesce("reach", F.lit(-1)) < F.col("seq")).drop("until", "reach")


def rewrite_policy_type(policies: DataFrame, allowed: list[str]) -> DataFrame:
    """``policies`` with kind replaced by the first allowed where it is none of them, in the document's own spelling, and changed."""
    ok = F.coalesce(local_name(F.col("kind")), F.lit("Set")).isin(allowed)
    spelled = F.when(F.col("kind").startswith(ODRL), ODRL + allowed[0]).when(F.col("kind").startswith("odrl:"), f"odrl:{allowed[0]}").otherwise(allowed[0])
    return policies.withColumn("changed", ~ok).withColumn("kind", F.when(ok, F.col("kind")).otherwise(spelled))


def limit_violations(items: DataFrame, limits: DataFrame) -> DataFrame:
    """doc_id, owner, list, n, least, most of lists (doc_id, owner, list) that hold too few or too many."""
    counted = items.groupBy("doc_id", "owner", "list").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(limits), "list").where("n < least or n > most").select("doc_id", "owner", "list", "n", "least", "most")


def logical_depth(path: Column) -> Column:
    """How many groups lie around a constraint."""
    return F.regexp_count(path, F.lit(r"child\["))


def odrl_position(parent: Column, list_: Column) -> Column:
    """Whether a follow-up list may stand under its parent's list."""
    # Parent and follow-up lists that go together.
    pairs = [("permission", "duty"), ("prohibition", "remedy"), ("obligation", "consequence"), ("duty", "consequence")]
    return F.concat(parent, F.lit("/"), list_).isin([f"{a}/{b}" for a, b in pairs])


#: Edits that fill a slot, whatever it holds.
SETS = ("SetText", "SetChoice", "SetIri")


def latest_edits(log: DataFrame) -> DataFrame:
    """doc_id, slot, value, n: the last value set in each slot (ops SetText, SetChoice, SetIri), by seq, and how many were; a slot removed last has none."""
    kept = log.where(F.col("op").isin(*SETS, "Remove"))
    last = kept.groupBy("doc_id", "slot").agg(F.max_by("value", "seq").alias("value"), F.max_by("op", "seq").alias("op"), F.count_if(F.col("op") != "Remove").alias("n"))
    return last.where("op <> 'Remove'").drop("op")


def apply_edit(version: int, slots: dict[str, str], op: str, slot: str, value: str | None, expect: int | None) -> bool:
    """Whether a document (its version and slots, which change) takes an edit.

    An edit that expects another version than the document has is refused as
    stale and changes nothing; Remove empties its slot, Add fills an empty one,
    the Set ops fill any.  The version is the number of edits taken.
    """
    known = slot in slots
    if (expect is not None and expect != version) or not (op in SETS or (op == "Remove" and known) or (op == "Add" and not known)):
        return False
    if op == "Remove":
        slots.pop(slot)
    else:
        slots[slot] = value
    return True


OUTCOME = "doc_id long, seq long, op string, expect long, accepted boolean, before long, version long, slot string, value string"


def replay_edits(log: DataFrame) -> DataFrame:
    """doc_id, seq, op, expect, accepted, before, version, slot, value: the outcome of each edit of a whole log.

    Edits are dealt by document and sorted; a task holds one document's slots at
    a time, never its edits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, version, slots = None, 0, {}
        for batch in batches:
            rows = []
            for doc_id, seq, op, slot, value, expect in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_id != doc:
                    doc, version, slots = doc_id, 0, {}
                before = version
                ok = apply_edit(version, slots, op, slot, value, expect)
                version += ok
                rows.append((doc_id, seq, op, expect, ok, before, version, slot, slots.get(slot)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in OUTCOME.split(", ")])

    rows = log.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), "op", "slot", "value", F.col("expect").cast("long").alias("expect"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(run, OUTCOME)


def stale_edits(log: DataFrame) -> DataFrame:
    """Edits that expect another version of their document than it has, the number of edits taken before: refused as stale."""
    return replay_edits(log).where("expect is not null and expect <> before").select("doc_id", "seq", "op", "expect", F.col("before").alias("version"))


# The contexts whose terms are known without reading them.
KNOWN_CONTEXTS = ("http://www.w3.org/ns/odrl.jsonld", "https://www.w3.org/ns/odrl.jsonld")
#: The path of a node whose context is applied: a document, an entry of a list of documents, an entry of a graph.
APPLIED = r"(?:\[[0-9]+\])*(?:\.?@graph(?:\[[0-9]+\])*)?"


def unread_contexts(rows: DataFrame) -> DataFrame:
    """doc_id, form, iri: contexts of flattened documents that are not applied, each once.

    ``remote``: a context by reference, or one that imports another, on a node whose context is applied;
    ``nested`` (iri null): any context further down.  What stands below ``@value`` is data.
    """
    listed = F.col("path").rlike(rf"^{APPLIED}\.?@context(?:\[[0-9]+\])?$") & ~F.regexp_replace("value", "/+$", "").isin(*KNOWN_CONTEXTS)
    imported = F.col("path").rlike(rf"^{APPLIED}\.?@context(?:\[[0-9]+\])?\.@import$")
    remote = (F.col("kind") == "string") & (listed | imported)
    inside = F.col("parent").rlike(r"(^|\.)@(context|value)($|[.\[])")
    own = (F.col("key") == "@context") & F.col("path").rlike("(^|[.])@context$")
    nested = own & ~inside & ~F.col("parent").rlike(f"^{APPLIED}$")
    forms = F.array_compact(F.array(F.when(remote, F.struct(F.lit("remote").alias("form"), F.col("value").alias("iri"))), F.when(nested, F.struct(F.lit("nested").alias("form"), F.lit(None).cast("string").alias("iri")))))
    return rows.where(F.coalesce(remote, F.lit(False)) | F.coalesce(nested, F.lit(False))).select("doc_id", F.inline(forms)).distinct()


#: Steps that the expansion of one key may take; a key that takes more counts as unread.
EXPANSIONS = 64


def _ancestors(path: Column) -> Column:
    """The paths that a path begins with, itself included."""
    parts = F.regexp_extract_all(path, F.lit(r"[.\[]?[^.\[]+"), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ""))


def _definitions(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the contexts of each document say: terms (doc_id, term, iri), ``@vocab`` (doc_id, iri), and terms that only mean JSON data (doc_id, term)."""
    told = rows.where(F.col("parent").rlike(r"(^|[.])@context($|[.\[])"))
    words = told.where("kind = 'string' and not startswith(key, '@')").select("doc_id", F.col("key").alias("term"), F.col("value").alias("iri"))
    wide = told.where("kind = 'object' and not startswith(key, '@')").select("doc_id", F.col("path").alias("parent"), F.col("key").alias("term"))
    ids = told.where("key = '@id' and kind = 'string'").select("doc_id", "parent", F.col("value").alias("iri"))
    typed = told.where("key = '@type' and value = '@json'").select("doc_id", "parent")
    terms = words.unionByName(wide.join(ids, ["doc_id", "parent"]).select("doc_id", "term", "iri")).distinct()
    plain = words.select("doc_id", "term").unionByName(wide.join(typed, ["doc_id", "parent"], "left_anti").select("doc_id", "term"))
    data = wide.join(typed, ["doc_id", "parent"]).select("doc_id", "term").distinct().join(plain.distinct(), ["doc_id", "term"], "left_anti")
    vocab = told.where("key = '@vocab' and kind = 'string' and value <> ''").select("doc_id", F.col("value").alias("iri")).distinct()
    return terms, vocab, data


def unread_keys(rows: DataFrame) -> DataFrame:
    """doc_id, key: keys of flattened documents that stand for ODRL terms but are not written bare, so were not read, each once.

    Keys expand as the document's contexts define them, whatever a definition's scope: through prefixes,
    other terms and ``@vocab``; ``odrl`` is always ODRL's.  Names in contexts, what stands below ``@value``
    and below terms that only mean JSON data are passed over.

    A round is one join of all spellings that are left with the definitions of their documents.  A
    spelling that comes back to itself, or still grows after 64 rounds, counts as unread.
    """
    rows = cut(rows, "rows")
    terms, vocab, data = _definitions(rows)
    terms = cut(terms, "terms")
    used = rows.where(F.col("key").isNotNull() & ~F.col("key").isin("@context", "@value") & ~F.col("parent").rlike(r"(^|[.])@(context|value)($|[.\[])"))
    below = used.withColumnRenamed("key", "term").join(data, ["doc_id", "term"]).select("doc_id", F.col("path").alias("above")).distinct()
    hidden = used.select("doc_id", "parent").distinct().withColumn("above", F.explode(_ancestors(F.col("parent")))).join(below, ["doc_id", "above"]).select("doc_id", "parent").distinct()
    keys = used.join(hidden, ["doc_id", "parent"], "left_anti").select("doc_id", "key").distinct()

    none = F.array().cast("array<string>")
    compact = keys.where("contains(key, ':')").select("doc_id", "key", F.lit("").alias("own"), F.col("key").alias("iri"), none.alias("path"))
    bare = keys.where("not contains(key, ':')").join(terms.withColumnRenamed("term", "key"), ["doc_id", "key"]).select("doc_id", "key", F.col("key").alias("own"), "iri", none.alias("path"))
    open_ = cut(compact.unionByName(bare), "spellings")
    found = []
    local = F.when(F.col("iri").startswith(ODRL), F.substr("iri", F.lit(len(ODRL) + 1)))
    colon = F.instr("iri", ":")
    head, rest = F.substring_index("iri", ":", 1), F.when(colon > 0, F.substr("iri", colon + 1)).otherwise("")
    for _ in range(EXPANSIONS):
        found.append(open_.where((local != "") & (local != F.col("own"))).select("doc_id", "key"))
        left = open_.where(local.isNull() & ~F.col("iri").startswith("@")).withColumns({"head": head, "rest": rest, "colon": colon > 0})
        left = left.where(~F.col("colon") | ~(F.col("rest").startswith("//") | (F.col("head") == "_")))
        by_term = left.join(terms.select("doc_id", F.col("term").alias("head"), F.col("iri").alias("to")), ["doc_id", "head"]).where("colon or to <> iri")
        by_vocab = left.where("not colon").withColumn("rest", F.col("iri")).join(vocab.withColumnRenamed("iri", "to"), "doc_id")
        by_odrl = left.where("colon and head = 'odrl'").withColumn("to", F.lit(ODRL))
        step = by_term.unionByName(by_vocab).unionByName(by_odrl).select("doc_id", "key", "own", F.concat("to", "rest").alias("iri"), F.concat("path", F.array("iri")).alias("path"))
        further = cut(step.groupBy("doc_id", "key", "own", "iri").agg(F.min("path").alias("path")), "spellings")
        again = F.array_contains("path", F.col("iri"))
        found.append(further.where(again).select("doc_id", "key"))
        open_ = further.where(~again)
        if open_.isEmpty():
            break
    else:
        found.append(open_.select("doc_id", "key"))
    return reduce(lambda a, b: a.unionByName(b), found).distinct()
