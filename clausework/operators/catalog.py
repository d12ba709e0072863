"""The catalog: features of documents, coverage by source, totals and gaps; examples in HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions.names import local_name
from clausework.model import FEATURES


def feature_table(spark: SparkSession) -> DataFrame:
    """grp, feature, ix: the features in their order."""
    return spark.createDataFrame([(g, f, i) for i, (g, f) in enumerate(FEATURES)], "grp string, feature string, ix int")


def features(keys: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct key columns and feature, from rows of key columns and ``key`` (a key or type in any spelling)."""
    named = keys.withColumn("feature", local_name(F.col("key"))).drop("key")
    return named.join(F.broadcast(table.select("feature")), "feature", "left_semi").distinct()


def policy_keys(policies: DataFrame, rules: DataFrame, constraints: DataFrame) -> DataFrame:
    """doc_id, policy_ix, key: every key and type that a policy of the derived corpus writes."""
    on = lambda df, col, key: df.where(F.col(col).isNotNull()).select("doc_id", "policy_ix", F.lit(key).alias("key"))
    value = lambda df, col: df.where(F.col(col).isNotNull()).select("doc_id", "policy_ix", F.col(col).alias("key"))
    parts = [
        value(policies, "kind"),
        *[on(policies, c, c) for c in ("assigner", "assignee", "target", "action", "conflict", "profile")],
        on(policies, "parent_ix", "inheritFrom"),
        value(rules, "list"),
        *[on(rules, c, c) for c in ("assigner", "assignee", "target", "action")],
        on(constraints, "path", "odrl:constraint"),
        value(constraints, "logical_op"),
        *[on(constraints, c, k) for c, k in (("unit", "unit"), ("datatype", "dataType"))],
    ]
    return reduce(DataFrame.unionByName, parts)


def coverage(found: DataFrame, table: DataFrame, sources: DataFrame) -> DataFrame:
    """grp, feature, ix, source, n: policies of each source with each feature, zeros filled in.

    The grid is features times sources, both small and fixed.
    """
    counts = found.groupBy("feature", "source").agg(F.count("*").alias("n"))
    grid = table.join(F.broadcast(sources.select("source").distinct()), F.lit(True))
    return grid.join(F.broadcast(counts), ["feature", "source"], "left").select("grp", "feature", "ix", "source", F.coalesce("n", F.lit(0)).alias("n"))


def source_totals(entries: DataFrame) -> DataFrame:
    """source, n, complete, with_warnings, incomplete from entries (source, incomplete, n_warnings)."""
    return entries.groupBy("source").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("incomplete") & (F.col("n_warnings") == 0)).alias("complete"),
        F.count_if(~F.col("incomplete") & (F.col("n_warnings") > 0)).alias("with_warnings"),
        F.count_if("incomplete").alias("incomplete"),
    )


def coverage_gaps(covered: DataFrame, corpus: str) -> DataFrame:
    """feature, used_by: features that other sources use and ``corpus`` does not."""
    used = covered.groupBy("feature").agg(
        F.max(F.when(F.col("source") == corpus, F.col("n"))).alias("here"),
        F.array_join(F.sort_array(F.collect_set(F.when((F.col("source") != corpus) & (F.col("n") > 0), F.col("source")))), ", ").alias("used_by"),
    )
    return used.where((F.coalesce("here", F.lit(0)) == 0) & (F.col("used_by") != "")).select("feature", "used_by")


def html_blocks(pages: DataFrame, tag: str = "p") -> DataFrame:
    """page_id, ix, text, heading: each ``tag`` block of a page without its markup, under the nearest heading above it.

    Texts stay inside their row until the blocks are found, so nothing is
    shuffled: the heading is the last one that ends before the block begins.  A
    piece of the page is searched once, for its block and for the headings that
    those after it stand under.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    last_heading = lambda c: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(c, F.lit(r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))), -1)
    pieces = F.transform(F.split("html", rf"(?=<{tag}[ >])", -1), lambda c: F.struct(F.regexp_extract(c, rf"(?s)^<{tag}[^>]*>(.*?)(?:</{tag}>|$)", 1).alias("body"), last_heading(c).alias("heading")))
    numbered = pages.select("page_id", pieces.alias("pieces")).select("page_id", "pieces", F.transform("pieces", lambda p: p["heading"]).alias("headings"))
    # For each piece the number of the nearest one before it with a heading, -1 if none.
    above = F.aggregate(
        "headings",
        F.struct(F.array().cast("array<int>").alias("above"), F.lit(-1).alias("last"), F.lit(0).alias("i")),
        lambda s, h: F.struct(F.array_append(s["above"], s["last"]).alias("above"), F.when(h.isNotNull(), s["i"]).otherwise(s["last"]).alias("last"), (s["i"] + 1).alias("i")),
        lambda s: s["above"],
    )
    told = numbered.select("page_id", "headings", F.posexplode(F.arrays_zip("pieces", above.alias("above"))).alias("ix", "z"))
    heading = F.when(F.col("z.above") >= 0, F.get("headings", F.col("z.above"))).otherwise("")
    return told.where("ix > 0").select("page_id", "ix", plain(F.col("z.pieces.body")).alias("text"), plain(heading).alias("heading"))


def live_links(urls: DataFrame, status: DataFrame) -> DataFrame:
    """The urls (url) known to answer 200; each url is asked for once."""
    return urls.select("url").distinct().join(status.where("status = 200").select("url").distinct(), "url", "left_semi")
