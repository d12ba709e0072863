"""Inheritance between policies: links, lineages, circles and what is passed down.

Where every policy of a document has one parent at most, pointers are doubled: a
chain or circle of n policies takes log2 n rounds.  Documents with a policy of
several parents are followed a step a round.  Each round writes its rows to the
shared folder, and only a count of it comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.operators.pointers import circles, orbits
from clausework.sources.shared import cut

PARTS = ("assigner", "assignee", "target", "action")
#: What ancestors lend where they agree.
LENT = (*PARTS, "conflict")
REMOTE = 16


def expanded_ids(df: DataFrame, col: str, prefixes: DataFrame | None) -> DataFrame:
    """``df`` (doc_id, col) with ``{col}_iri``: a compact IRI written out by the prefixes (doc_id, prefix, namespace) of its document, else as written."""
    if prefixes is None:
        return df.withColumn(f"{col}_iri", F.col(col))
    head, tail = F.substring_index(col, ":", 1), F.expr(f"substring({col}, instr({col}, ':') + 1)")
    bound = prefixes.select(F.col("doc_id").alias("b_doc"), F.col("prefix").alias("b_prefix"), F.col("namespace").alias("b_ns"))
    compact = F.col(col).contains(":") & ~tail.startswith("//")
    joined = df.join(bound, (F.col("doc_id") == F.col("b_doc")) & compact & (head == F.col("b_prefix")), "left")
    return joined.withColumn(f"{col}_iri", F.coalesce(F.concat("b_ns", tail), col)).drop("b_doc", "b_prefix", "b_ns")


def inherit_links(policies: DataFrame, inherits: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """doc_id, policy_ix, parent, parent_ix: the first policy of the document with the parent's uid, null if none.

    Both are expanded first, so a compact and a full IRI meet.
    """
    uids = expanded_ids(policies.where("uid is not null").select("doc_id", "policy_ix", "uid"), "uid", prefixes)
    first = uids.groupBy(F.col("doc_id").alias("u_doc"), "uid_iri").agg(F.min("policy_ix").alias("parent_ix"))
    named = expanded_ids(inherits, "parent", prefixes)
    return named.join(first, (F.col("doc_id") == F.col("u_doc")) & (F.col("parent_iri") == F.col("uid_iri")), "left").select("doc_id", "policy_ix", "parent", "parent_ix")


def _edges(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, child, parent_ix of the documents whose policies have one parent at most, and of the others (None if there are none)."""
    edges = cut(links.where("parent_ix is not null").select("doc_id", F.col("policy_ix").alias("child"), "parent_ix").distinct(), "edges")
    several = edges.groupBy("doc_id", "child").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").distinct()
    several = cut(several, "several")
    if several.isEmpty():
        return edges, None
    return edges.join(several, "doc_id", "left_anti"), edges.join(several, "doc_id", "left_semi")


def _pointers(edges: DataFrame) -> DataFrame:
    return edges.select("doc_id", F.col("child").alias("node"), F.col("parent_ix").alias("to"))


def lineages(links: DataFrame, cap: int = 20_000) -> DataFrame:
    """doc_id, policy_ix, ancestor_ix, ix: every ancestor of a policy once, depth first, never itself.

    All lineages of a document together list ``cap`` ancestors at most, those of its first policies, as the model has it.
    """
    single, several = _edges(links)
    walked = orbits(_pointers(single), single.select("doc_id", F.col("child").alias("start")), "doc_id", cap).where("at <> start")
    walked = walked.select("doc_id", F.col("start").alias("policy_ix"), F.col("at").alias("ancestor_ix"), F.array("ix").alias("path"))
    once = walked if several is None else walked.unionByName(_least_paths(several))
    ix = F.row_number().over(Window.partitionBy("doc_id", "policy_ix").orderBy("path")) - 1
    whole = F.row_number().over(Window.partitionBy("doc_id").orderBy("policy_ix", "path"))
    return once.withColumns({"ix": ix, "listed": whole}).where(F.col("listed") <= cap).select("doc_id", "policy_ix", "ancestor_ix", "ix")


def _least_paths(edges: DataFrame) -> DataFrame:
    """doc_id, policy_ix, ancestor_ix, path: the least path of turns to each ancestor.

    A round goes one step on from the pairs whose path has become less, so a pair
    has one path at a time, however many lead to it.
    """
    key = ["doc_id", "policy_ix", "ancestor_ix"]
    up = cut(
        edges.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "child").orderBy("parent_ix"))).select(
            "doc_id", F.col("child").alias("ancestor_ix"), F.col("parent_ix").alias("next_ix"), "turn"
        ),
        "up",
    )
    first = up.where("ancestor_ix <> next_ix").select(
        "doc_id", F.col("ancestor_ix").alias("policy_ix"), F.col("next_ix").alias("ancestor_ix"), F.array("turn").alias("path"), F.array("ancestor_ix", "next_ix").alias("seen")
    )
    frontier = known = cut(first, "frontier")
    while not frontier.isEmpty():
        step = (
            frontier.join(up, ["doc_id", "ancestor_ix"])
            .where(~F.array_contains("seen", F.col("next_ix")))
            .select("doc_id", "policy_ix", F.col("next_ix").alias("ancestor_ix"), F.concat("path", F.array("turn")).alias("path"), F.concat("seen", F.array("next_ix")).alias("seen"))
        )
        best = step.groupBy(*key).agg(F.min(F.struct("path", "seen")).alias("best"))
        less = best.join(known.select(*key, F.col("path").alias("old")), key, "left").where("old is null or best.path < old")
        frontier = cut(less.select(*key, "best.path", "best.seen"), "frontier")
        known = cut(known.join(frontier.select(*key), key, "left_anti").unionByName(frontier), "known")
    return known.select(*key, "path")


def on_cycle(links: DataFrame) -> DataFrame:
    """doc_id, policy_ix of the policies that inherit from themselves.

    In documents with a policy of several parents, what has no parent or no child
    among the rest is dropped again and again; only what is left, circles and
    bridges between them, is followed further.
    """
    single, several = _edges(links)
    found = circles(_pointers(single), "doc_id").select("doc_id", F.col("node").alias("policy_ix"))
    if several is None:
        return found
    rest = cut(several, "rest")
    n = rest.count()
    while n:
        children = rest.select("doc_id", F.col("child").alias("parent_ix")).distinct()
        parents = rest.select("doc_id", F.col("parent_ix").alias("child")).distinct()
        rest = cut(rest.join(children, ["doc_id", "parent_ix"], "left_semi").join(parents, ["doc_id", "child"], "left_semi"), "rest")
        left = rest.count()
        if left == n:
            break
        n = left
    if not n:
        return found
    reach = cut(rest.select("doc_id", F.col("child").alias("a"), F.col("parent_ix").alias("b")), "reach")
    size = reach.count()
    while True:
        further = reach.select("doc_id", F.col("a").alias("b"), F.col("b").alias("c"))
        step = reach.join(further, ["doc_id", "b"]).select("doc_id", "a", F.col("c").alias("b"))
        reach = cut(reach.unionByName(step).distinct(), "reach")
        more = reach.count()
        if more == size:
            return found.unionByName(reach.where("a = b").select("doc_id", F.col("a").alias("policy_ix")))
        size = more


def inherited_mask(policies: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, policy_ix, mask: bits of the parts that the policy or an ancestor has, and 16 for a parent that is not there."""
    key = ["doc_id", "policy_ix"]
    remote = links.where("parent_ix is null").select(*key).distinct().withColumn("remote", F.lit(REMOTE))
    own = sum((F.when(F.col(p).isNotNull(), 1 << i).otherwise(0) for i, p in enumerate(PARTS)), F.lit(0))
    masks = policies.join(remote, key, "left").select(*key, (own + F.coalesce("remote", F.lit(0))).cast("int").alias("mask"))
    masks = cut(masks, "masks")
    single, several = _edges(links)
    lent = _doubled_masks(masks, single)
    if several is not None:
        lent = lent.unionByName(_stepped_masks(masks, several))
    return masks.join(lent.withColumnRenamed("mask", "grown"), key, "left").select(*key, F.coalesce("grown", "mask").alias("mask"))


def _doubled_masks(masks: DataFrame, edges: DataFrame) -> DataFrame:
    """Masks of the policies on edges of one parent each: a policy has those of its next 2**k ancestors after k rounds.

    Once a round changes no mask, what lies further on adds nothing either.
    """
    parents = edges.select("doc_id", F.col("parent_ix").alias("policy_ix"), F.lit(None).cast("int").alias("to"))
    nodes = edges.select("doc_id", F.col("child").alias("policy_ix"), F.col("parent_ix").alias("to")).unionByName(parents)
    nodes = nodes.groupBy("doc_id", "policy_ix").agg(F.max("to").alias("to"))  # one parent at most: the one that is not null
    state = cut(nodes.join(masks, ["doc_id", "policy_ix"]).select("doc_id", "policy_ix", "to", "mask"), "masks")
    while True:
        above = state.select("doc_id", F.col("policy_ix").alias("to"), F.col("to").alias("next"), F.col("mask").alias("above"))
        state = cut(
            state.join(above, ["doc_id", "to"], "left").select(
                "doc_id", "policy_ix", F.col("next").alias("to"), F.col("mask").bitwiseOR(F.coalesce("above", F.lit(0))).alias("mask"), F.col("mask").alias("old")
            ),
            "masks",
        )
        if state.where("old <> mask").isEmpty():
            return state.select("doc_id", "policy_ix", "mask")


def _stepped_masks(masks: DataFrame, edges: DataFrame) -> DataFrame:
    """Masks of the documents of edges, each round handed down by one step."""
    edges = cut(edges, "edges")
    masks = cut(masks.join(edges.select("doc_id").distinct(), "doc_id", "left_semi"), "masks")
    while True:
        lent = (
            edges.join(masks.select("doc_id", F.col("policy_ix").alias("parent_ix"), "mask"), ["doc_id", "parent_ix"])
            .groupBy("doc_id", F.col("child").alias("policy_ix"))
            .agg(F.bit_or("mask").alias("lent"))
        )
        grown = cut(
            masks.join(lent, ["doc_id", "policy_ix"], "left").select(
                "doc_id", "policy_ix", F.col("mask").alias("old"), F.col("mask").bitwiseOR(F.coalesce("lent", F.lit(0))).alias("mask")
            ),
            "masks",
        )
        if grown.where("old <> mask").isEmpty():
            return grown.select("doc_id", "policy_ix", "mask")
        masks = grown.drop("old")


def lent_values(lineage: DataFrame, policies: DataFrame) -> DataFrame:
    """doc_id, policy_ix, key, value: what all ancestors that state it state the same."""
    stated = policies.select(
        "doc_id", F.col("policy_ix").alias("ancestor_ix"), F.explode(F.create_map(*[x for p in LENT for x in (F.lit(p), F.col(p))])).alias("key", "value")
    ).where("value is not null")
    agreed = lineage.join(stated, ["doc_id", "ancestor_ix"]).groupBy("doc_id", "policy_ix", "key").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    return agreed.where("value = other").drop("other")


def written_profiles(policies: DataFrame, lineage: DataFrame) -> DataFrame:
    """doc_id, policy_ix, ix, profile: a policy's own profile, then each ancestor's that is not yet listed."""
    own = policies.where("profile is not null").select("doc_id", "policy_ix", F.lit(-1).alias("at"), "profile")
    from_above = lineage.join(policies.select("doc_id", F.col("policy_ix").alias("ancestor_ix"), "profile"), ["doc_id", "ancestor_ix"]).where(
        "profile is not null"
    ).select("doc_id", "policy_ix", F.col("ix").alias("at"), "profile")
    first = own.unionByName(from_above).groupBy("doc_id", "policy_ix", "profile").agg(F.min("at").alias("at"))
    ix = F.row_number().over(Window.partitionBy("doc_id", "policy_ix").orderBy("at")) - 1
    return first.withColumn("ix", ix).select("doc_id", "policy_ix", "ix", "profile")
