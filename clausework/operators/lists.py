"""Lists, aliases, closed lists, layers, suggestions and fixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.operators.pointers import APPENDED, orbits
from clausework.sources.shared import cut


def walk_lists(triples: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """graph_id, head, ix, item of every rdf list (s, p in rdf:first and rdf:rest, o_iri), each list once.

    All lists are followed at once, twice as far in each round; a list that bites
    its tail ends there.  ``heads`` (graph_id, start) are the cells to begin at, else those that no cell leads to.
    """
    first = triples.where("p = 'rdf:first'").select("graph_id", F.col("s").alias("cell"), F.col("o_iri").alias("item"))
    rest = triples.where("p = 'rdf:rest' and o_iri <> 'rdf:nil'").select("graph_id", F.col("s").alias("cell"), F.col("o_iri").alias("next"))
    cells = cut(first.join(rest, ["graph_id", "cell"], "left"), "cells")
    if heads is None:
        inner = cells.select("graph_id", F.col("next").alias("cell")).where("cell is not null")
        heads = cells.join(inner, ["graph_id", "cell"], "left_anti").select("graph_id", F.col("cell").alias("start"))
    walked = orbits(cells.select("graph_id", F.col("cell").alias("node"), F.col("next").alias("to")), heads, "graph_id")
    return walked.join(cells.select("graph_id", F.col("cell").alias("at"), "item"), ["graph_id", "at"]).select("graph_id", F.col("start").alias("head"), "ix", "item")


def follow_lists(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """graph_id, s, ix, item of the list that each of ``starts`` (graph_id, s, head) begins; ``cells``: graph_id, cell, item, next.

    Lists are followed a cell a round, so only what goes on is shuffled; what is longer than ``APPENDED`` cells is then
    followed twice as far in each round.  A list that bites its tail ends there.
    """
    out, at = [], starts.select("graph_id", "s", F.lit(0).alias("ix"), F.col("head").alias("cell"), F.array().cast("array<string>").alias("seen"))
    for _ in range(APPENDED):
        step = cut(at.join(cells, ["graph_id", "cell"]).withColumn("seen", F.concat("seen", F.array("cell"))), "list")
        out.append(step.select("graph_id", "s", "ix", "item"))
        at = step.where(F.col("next").isNotNull() & ~F.array_contains("seen", F.col("next"))).select("graph_id", "s", (F.col("ix") + 1).alias("ix"), F.col("next").alias("cell"), "seen")
        if at.isEmpty():
            break
    else:
        walked = orbits(cells.select("graph_id", F.col("cell").alias("node"), F.col("next").alias("to")), at.select("graph_id", F.col("cell").alias("start")).distinct(), "graph_id")
        further = at.withColumnRenamed("cell", "start").join(walked.withColumnRenamed("ix", "on"), ["graph_id", "start"]).where(~F.array_contains("seen", F.col("at")))
        out.append(further.withColumnRenamed("at", "cell").join(cells, ["graph_id", "cell"]).select("graph_id", "s", (F.col("ix") + F.col("on")).alias("ix"), "item"))
    return reduce(DataFrame.unionByName, out)


def resolve_aliases(prefixes: DataFrame, passes: int = 4) -> DataFrame:
    """doc_id, key, iri with keys that stand for ``other:rest`` written out, a join a pass."""
    out = prefixes
    for _ in range(passes):
        to = out.select(F.col("doc_id").alias("t_doc"), F.col("key").alias("t_key"), F.col("iri").alias("t_iri"))
        head, tail = F.substring_index("iri", ":", 1), F.expr("substring(iri, instr(iri, ':') + 1)")
        names = F.col("iri").contains(":") & ~tail.startswith("//")
        out = out.join(to, (F.col("doc_id") == F.col("t_doc")) & names & (head == F.col("t_key")) & (F.col("key") != F.col("t_key")), "left").select(
            "doc_id", "key", F.when(F.col("t_iri").isNotNull(), F.concat("t_iri", tail)).otherwise(F.col("iri")).alias("iri")
        )
    return out


def outside_list(rows: DataFrame, col: str, listed: DataFrame) -> DataFrame:
    """Rows whose ``col`` is set and not in a closed list (value)."""
    return rows.where(F.col(col).isNotNull()).join(listed.select(F.col("value").alias(col)), col, "left_anti")


def overlay_orphans(overlay: DataFrame, terms: DataFrame) -> DataFrame:
    """Overlay rows (left_iri) about what no loaded profile has as a left operand."""
    known = terms.where("kind = 'LeftOperand'").select(F.col("iri").alias("left_iri")).distinct()
    return overlay.join(known, "left_iri", "left_anti")


def layer_hints(base: DataFrame, patches: list[tuple[str, DataFrame]], facets: list[str], key: str = "left_iri") -> DataFrame:
    """Hints facet by facet: a later layer's facet takes the place of an earlier one's, with the layer it came from."""
    out = base.select(key, *facets, *[F.when(F.col(f).isNotNull(), "base").alias(f"src_{f}") for f in facets])
    for name, patch in patches:
        p = patch.select(F.col(key).alias("p_key"), *[F.col(f).alias(f"p_{f}") for f in facets])
        joined = out.join(p, out[key] == F.col("p_key"), "full")
        out = joined.select(
            F.coalesce(key, "p_key").alias(key),
            *[F.coalesce(f"p_{f}", f).alias(f) for f in facets],
            *[F.when(F.col(f"p_{f}").isNotNull(), name).otherwise(F.col(f"src_{f}")).alias(f"src_{f}") for f in facets],
        )
    return out


def filter_suggestions(options: DataFrame, query: str, most: int) -> DataFrame:
    """The first ``most`` options (ix, label, hint, grp) that match: beginnings before insides before hints; groups in the
    order of their first match, the options' own order inside."""
    label, q = F.lower("label"), query.lower()
    rank = F.when(label.startswith(q), 0).when(label.contains(q), 1).when(F.lower(F.coalesce("hint", F.lit(""))).contains(q), 2)
    hits = options.withColumn("rank", rank).where("rank is not null")
    groups = hits.groupBy("grp").agg(F.min(F.struct("rank", "ix")).alias("grp_at"))
    return hits.join(groups, "grp").orderBy("grp_at", "rank", "ix").limit(most).select("ix", "label", "grp", "rank")


def first_declaration(declared: DataFrame) -> DataFrame:
    """doc_id, iri and the place (ord) of the first declaration of each identifier."""
    return declared.groupBy("doc_id", "iri").agg(F.min("ord").alias("ord"))


def dedupe_notes(notes: DataFrame, cap: int | None = None) -> DataFrame:
    """doc_id, ix, note: each note of a document once, in the order of its first place (ord), with n_more beyond ``cap``."""
    once = notes.groupBy("doc_id", "note").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("doc_id")
    out = once.withColumn("ix", F.row_number().over(w.orderBy("ord", "note")) - 1).withColumn("n", F.count("*").over(w))
    kept = out if cap is None else out.where(F.col("ix") < cap)
    return kept.select("doc_id", "ix", "note", F.greatest(F.col("n") - (cap if cap is not None else F.col("n")), F.lit(0)).alias("n_more"))


def inherited_rules(rules: DataFrame, lineage: DataFrame, cap: int = 5000) -> DataFrame:
    """doc_id, policy_ix, ix, from_ix, path: the rules of a policy's ancestors in the order of its lineage, ``cap`` at most."""
    above = rules.select("doc_id", F.col("policy_ix").alias("ancestor_ix"), "rule_ix", "path")
    met = lineage.withColumnRenamed("ix", "at").join(above, ["doc_id", "ancestor_ix"])
    ix = F.row_number().over(Window.partitionBy("doc_id", "policy_ix").orderBy("at", "rule_ix")) - 1
    return met.withColumn("ix", ix).where(F.col("ix") < cap).select("doc_id", "policy_ix", "ix", F.col("ancestor_ix").alias("from_ix"), "path")


def safe_fixes(findings: DataFrame, expanded: DataFrame) -> DataFrame:
    """doc_id, path, slot, written, replacement: the full IRI for a term whose prefix only a profile binds."""
    found = _expanded_findings(findings.where("rule = 'profile.unbound-prefix'"), expanded)
    return found.select("doc_id", "path", "slot", "written", F.col("iri").alias("replacement"))


def _expanded_findings(findings: DataFrame, expanded: DataFrame) -> DataFrame:
    """doc_id, path, slot, written, rule, iri, each once: findings that say their own iri need no other table."""
    on = ["doc_id", "path", "slot", "written"]
    if "iri" in findings.columns:
        return findings.select(*on, "rule", "iri").distinct()
    return findings.select(*on, "rule").distinct().join(expanded.select(*on, "iri").distinct(), on)


def fixes(term_findings: DataFrame, expanded: DataFrame, terms: DataFrame, profiles: DataFrame, hint_findings: DataFrame, constraints: DataFrame, duplicates: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, path, rule, slot, label, safe, replacement: what mends a finding, for the five kinds of finding that can be mended.

    The full IRI for a prefix that only a profile binds; a profile to declare, for a term of it; a string to be
    written as the IRI that it is; a repeated action that says the same, to be removed (its
    replacement is empty); a group around one condition, to be taken away.  All are safe.
    """
    found = _expanded_findings(term_findings, expanded)
    order = F.struct("load_order", "term_ix")
    owner = terms.groupBy("iri").agg(F.min_by("profile_id", order).alias("profile_id")).join(profiles.select("profile_id", F.col("iri").alias("by")), "profile_id").select("iri", "by")
    full = found.where("rule = 'profile.unbound-prefix'").select("doc_id", "path", "rule", "slot", F.lit("Write the full IRI").alias("label"), F.col("iri").alias("replacement"))
    declare = found.where("rule = 'profile.not-declared'").join(owner, "iri").select(
        "doc_id", "path", "rule", "slot", F.concat(F.lit("Declare the profile <"), "by", F.lit(">")).alias("label"), F.col("by").alias("replacement")
    )
    written = hint_findings.where("rule = 'prose.iri-expected'").select("doc_id", "path", "rule").distinct().join(constraints.select("doc_id", "path", "raw"), ["doc_id", "path"])
    as_iri = written.select("doc_id", "path", "rule", F.lit("value").alias("slot"), F.lit("Write it as an IRI").alias("label"), F.col("raw").alias("replacement"))
    none = F.lit("").alias("replacement")
    at = F.concat("owner", F.lit(".action["), F.col("ix").cast("string"), F.lit("]"))
    remove = duplicates.where("removable").select("doc_id", at.alias("path"), F.lit("heuristic.duplicate-action").alias("rule"), F.lit("action").alias("slot"), F.lit("Remove the duplicate").alias("label"), none)
    ungroup = groups.where("rule = 'heuristic.single-child-group'").select("doc_id", "path", "rule", F.lit("group").alias("slot"), F.lit("Ungroup").alias("label"), none)
    parts = [full, declare, as_iri, remove, ungroup]
    return reduce(DataFrame.unionByName, parts).withColumn("safe", F.lit(True))


def apply_safe_fixes(uses: DataFrame, fixes: DataFrame) -> DataFrame:
    """Term uses with the replacements of their fixes."""
    on = ["doc_id", "path", "slot", "written"]
    return uses.join(fixes.select(*on, "replacement").distinct(), on, "left").withColumn("written", F.coalesce("replacement", "written")).drop("replacement")


def admissible(judged: DataFrame, others: DataFrame) -> DataFrame:
    """Proposals (doc_id, path, slot, written) with ok and the rule that refuses them; only refusable rules do.

    ``judged`` bring the rules that they break, ``others`` break none: nothing is looked up again, so no proposal is dealt by its place.
    """
    refusable = ["profile.undeclared-in-namespace", "profile.unknown-term", "profile.wrong-kind", "profile.conflict-term", "profile.unbound-prefix"]
    columns = ["doc_id", "path", "slot", "written"]
    against = F.array_min(F.filter("rules", lambda r: r.isin(refusable)))
    told = judged.select(*columns, against.alias("rule")).unionByName(others.select(*columns, F.lit(None).cast("string").alias("rule")))
    return told.withColumn("ok", F.col("rule").isNull())


def prefix_is_odrl(contexts: DataFrame, namespace: str) -> DataFrame:
    """doc_id, ok: whether every binding of the prefix odrl in a document's contexts (key, iri) is ODRL's."""
    return contexts.groupBy("doc_id").agg(F.coalesce(F.bool_and(F.when(F.col("key") == "odrl", F.col("iri") == namespace)), F.lit(True)).alias("ok"))


def pivot_terms(triples: DataFrame) -> DataFrame:
    """graph_id, iri, kind, n_labels, broader, deprecated: triples of a subject in one row, by conditional aggregates."""
    when = lambda p, c: F.when(F.col("p") == p, F.col(c))
    return triples.groupBy("graph_id", F.col("s").alias("iri")).agg(
        F.min(when("rdf:type", "o_iri")).alias("kind"),
        F.count(when("rdfs:label", "o_value")).alias("n_labels"),
        F.array_join(F.sort_array(F.collect_set(when("skos:broader", "o_iri"))), ",").alias("broader"),
        F.coalesce(F.bool_or(when("owl:deprecated", "o_value") == "true"), F.lit(False)).alias("deprecated"),
    )


def action_tree(edges: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """root, iri, path: terms below roots along their first parent (ix), depth first by path; circles are cut where they close."""
    first = edges.groupBy("child").agg(F.min_by("parent", "ix").alias("parent"))
    order = Window.partitionBy("parent").orderBy("child")
    placed = first.withColumn("place", F.row_number().over(order))
    at = roots.select(F.col("iri").alias("root"), "iri", F.array().cast("array<int>").alias("path"), F.array("iri").alias("seen"))
    found = at
    for _ in range(depth):
        at = cut(
            at.join(placed, at["iri"] == placed["parent"]).where(~F.array_contains("seen", F.col("child"))).select(
                "root", F.col("child").alias("iri"), F.concat("path", F.array("place")).alias("path"), F.concat("seen", F.array("child")).alias("seen")
            ),
            "tree",
        )
        if at.isEmpty():
            break
        found = found.unionByName(at)
    return found.select("root", "iri", "path")


def class_members(classes: DataFrame, types: DataFrame, below: DataFrame, cap: int) -> DataFrame:
    """cls, iri: what is typed with a class, the class itself and what lies below it; a class with more than ``cap`` closes nothing."""
    members = (
        classes.select(F.col("iri").alias("cls"), "iri")
        .unionByName(types.join(classes.select(F.col("iri").alias("kind")), "kind").select(F.col("kind").alias("cls"), "iri"))
        .unionByName(below.select(F.col("root").alias("cls"), "iri"))
        .distinct()
    )
    small = members.groupBy("cls").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("cls")
    return members.join(small, "cls", "left_semi")


def same_text(a: Column, b: Column) -> Column:
    """Two literals are the same as texts or as numbers."""
    return (a == b) | F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False))
