"""Policies inside other documents: definitions, offers in messages, catalogs.

``rows``: the flattening of the documents, with ``last``, the place of a node's last
descendant, so that what lies below a node is an interval of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions.names import local_name
from clausework.model import ODRL
from clausework.sources.shared import cut

# The types and members that make an object a policy.
TYPES = ("Policy", "Set", "Offer", "Agreement", "Request", "Ticket", "Privacy", "Assertion")
LISTS = ("permission", "prohibition", "obligation")


def bare(name: Column) -> Column:
    """A name without ODRL's prefix or namespace; a name of another vocabulary stays."""
    return F.when(name.startswith("odrl:") | name.startswith(ODRL), local_name(name)).otherwise(name)


def _objects(rows: DataFrame) -> DataFrame:
    """doc_id, seq, last, depth of the objects that are policies by a list of rules or a type."""
    lists = rows.where(bare(F.col("key")).isin(*LISTS)).select("doc_id", F.col("up").alias("seq"))
    typed = rows.where((F.col("key") == "@type") & (F.col("kind") == "string") & bare(F.col("value")).isin(*TYPES)).select("doc_id", "up")
    of_lists = rows.where("key = '@type' and kind = 'list'").select("doc_id", F.col("seq").alias("up"), F.col("up").alias("owner"))
    types = typed.join(of_lists, ["doc_id", "up"], "left").select("doc_id", F.coalesce("owner", "up").alias("seq"))
    objects = rows.where("kind = 'object'").select("doc_id", "seq", "last", "depth")
    return lists.unionByName(types).distinct().join(objects, ["doc_id", "seq"])


def policies_in(rows: DataFrame) -> DataFrame:
    """doc_id, policy_ix, path, seq, last, context: the outermost policies of each document, in order, and the nearest ``@context`` at or above each.

    Nodes are intervals that nest: what an earlier policy or context reaches lies in it and is none.  Of the objects of one
    depth only the last that begins before a policy can hold it, so the deepest one that reaches so far has the nearest context.
    """
    marked = _objects(rows).withColumn("is_policy", F.lit(True))
    contexts = rows.where("key = '@context' and kind in ('object', 'list')").select("doc_id", "seq", "last", "depth", F.lit(False).alias("is_policy"))
    before = Window.partitionBy("doc_id").orderBy("seq", "is_policy").rowsBetween(Window.unboundedPreceding, -1)
    reached = marked.unionByName(contexts).withColumn("reach", F.coalesce(F.max("last").over(before), F.lit(-1)))
    found = cut(reached.where(F.col("is_policy") & (F.col("reach") < F.col("seq"))).select("doc_id", "seq", "last", "depth"), "outermost")

    objects = rows.where("kind = 'object'").select("doc_id", F.col("seq").alias("up"), F.col("last").alias("until"), F.col("depth").alias("at"))
    owners = rows.where("key = '@context'").select("doc_id", "up", F.struct(F.col("seq").alias("context_seq")).alias("own")).join(objects, ["doc_id", "up"])
    owners = cut(owners.select("doc_id", "at", F.col("up").alias("seq"), "until", "own.context_seq"), "owners")
    depths = F.array(*[F.lit(r.at) for r in owners.select("at").distinct().collect()]).cast("array<int>")  # levels that are followed: a bounded number
    asked = found.select("doc_id", F.explode(F.filter(depths, lambda d: d <= F.col("depth"))).alias("at"), "seq", F.lit(True).alias("asks"))
    both = owners.select("doc_id", "at", "seq", F.struct("until", "context_seq").alias("owner"), F.lit(False).alias("asks")).unionByName(asked.withColumn("owner", F.lit(None).cast("struct<until: int, context_seq: int>")))
    upto = Window.partitionBy("doc_id", "at").orderBy("seq", "asks").rowsBetween(Window.unboundedPreceding, 0)
    holds = both.withColumn("owner", F.last("owner", ignorenulls=True).over(upto)).where("asks and owner.until >= seq")
    nearest = holds.groupBy("doc_id", "seq").agg(F.max_by("owner.context_seq", "at").alias("context_seq"))

    paths = rows.select("doc_id", F.col("seq").alias("p_seq"), "path")
    told = found.join(nearest, ["doc_id", "seq"], "left").join(paths.withColumnRenamed("p_seq", "seq"), ["doc_id", "seq"])
    of_context = rows.where("key = '@context'").select("doc_id", F.col("seq").alias("context_seq"), F.col("path").alias("context"))
    ix = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return told.join(of_context, ["doc_id", "context_seq"], "left").select("doc_id", ix.alias("policy_ix"), "path", "seq", "last", "context")


def policy_rows(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """doc_id, policy_ix and the rows of each policy as a document of its own: paths from its root, the context above it first.

    Policies are disjoint intervals, so a row belongs to the last one that begins before it, if that one reaches so far:
    one sorted pass, no pairs.
    """
    starts = policies.select("doc_id", "seq", F.struct("policy_ix", F.col("path").alias("root"), "last").alias("start"))
    known = rows.join(starts, ["doc_id", "seq"], "left")
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = known.withColumn("start", F.last("start", ignorenulls=True).over(before)).where("start is not null and seq <= start.last")

    def rooted(df: DataFrame, root: Column, name: str) -> DataFrame:
        """Paths behind ``root``, below a member ``name`` (the root itself if empty)."""
        rest = F.regexp_replace(F.substr("path", F.length(root) + 1), r"^\.", "") if not name else F.concat(F.lit(name), F.substr("path", F.length(root) + 1))
        above = F.when(F.col("path") == root, F.lit("" if name else None).cast("string")).otherwise(
            F.regexp_replace(F.substr("parent", F.length(root) + 1), r"^\.", "") if not name else F.concat(F.lit(name), F.substr("parent", F.length(root) + 1))
        )
        return df.withColumns({"path": rest, "parent": above})

    cols = ["doc_id", "policy_ix", "path", "parent", "key", "pos", "depth", "kind", "value", "error", "seq"]
    base = policies.select("doc_id", "policy_ix", F.col("path").alias("top"), "context").join(
        rows.select("doc_id", F.col("path").alias("top"), F.col("depth").alias("top_depth")), ["doc_id", "top"]
    )
    own = inside.select("*", F.col("start.policy_ix").alias("policy_ix")).join(base.select("doc_id", "policy_ix", "top_depth"), ["doc_id", "policy_ix"])
    own = rooted(own.withColumn("depth", F.col("depth") - F.col("top_depth")), F.col("start.root"), "")
    own = own.withColumn("key", F.when(F.col("path") != "", F.col("key")))
    # A context above is shared by the policies below it.
    lent = base.where("context is not null and context <> case when top = '' then '@context' else top || '.@context' end").select("doc_id", "policy_ix", "context")
    heads = rows.join(lent.select("doc_id", F.col("context").alias("path")).distinct(), ["doc_id", "path"]).select("doc_id", "seq", F.struct(F.col("path").alias("root"), "last", F.col("depth").alias("d")).alias("start"))
    held = rows.join(heads, ["doc_id", "seq"], "left").withColumn("start", F.last("start", ignorenulls=True).over(before)).where("start is not null and seq <= start.last")
    held = rooted(held.withColumn("depth", F.col("depth") - F.col("start.d") + 1).withColumn("pos", F.when(F.col("path") == F.col("start.root"), -1).otherwise(F.col("pos"))), F.col("start.root"), "@context")
    held = held.withColumn("context", F.col("start.root")).join(lent, ["doc_id", "context"])
    return own.select(*cols).unionByName(held.select(*cols))
