"""Hints in four layers: a profile's own, an overlay's, shapes', a host's.

One row an operand (left_iri) with its facets: ``operators``, ``values`` (IRIs),
``literals``, ``units`` (arrays, empty if not given), ``datatype``, ``lexical``
(pattern, flags, low, high), and how it binds: ``closed``, ``values_only`` (for its
values alone), ``values_exact`` (nothing narrower counts), ``plural``, with the
layer that each facet came from in ``src_*``.  A later layer's facet takes the place
of an earlier one's; what the earlier ones only suggested goes or stays with how the
later one binds.  Vocabularies are small; a layer is one full join on the operand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = ("operators", "values", "literals", "units")
SCALARS = ("datatype", "lexical")
FLAGS = ("closed", "values_only", "values_exact", "plural")
SOURCES = ("src_operators", "src_values", "src_units", "src_datatype", "src_lexical")
COLUMNS = (*LISTS, *SCALARS, *FLAGS, *SOURCES)
LEXICAL = "struct<pattern: string, flags: string, low: string, high: string>"
NONE = "array<string>"


def facets(df: DataFrame, source: str) -> DataFrame:
    """``df`` (left_iri and any of the facets) with every column of a layer; all it gives comes from ``source``."""
    have = set(df.columns)
    lists = [(F.coalesce(F.col(c), F.array().cast(NONE)) if c in have else F.array().cast(NONE)).alias(c) for c in LISTS]
    scalars = [(F.col(c) if c in have else F.lit(None)).cast("string" if c == "datatype" else LEXICAL).alias(c) for c in SCALARS]
    flags = [(F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)).alias(c) for c in FLAGS]
    full = df.select("left_iri", *lists, *scalars, *flags)
    own = {"src_operators": _some("operators"), "src_values": _some("values") | _some("literals"), "src_units": _some("units"), "src_datatype": F.col("datatype").isNotNull(), "src_lexical": _lexical("lexical")}
    return full.select("*", *[F.when(given, source).alias(name) for name, given in own.items()])


def _some(c: str) -> Column:
    return F.size(c) > 0


def _lexical(c: str) -> Column:
    return F.coalesce(F.col(c)["pattern"], F.col(c)["low"], F.col(c)["high"]).isNotNull()


def layer(base: DataFrame, patch: DataFrame, source: str) -> DataFrame:
    """``base`` with ``patch`` (both as ``facets`` gives them) laid over it; ``source``: ``overlay``, ``shapes`` or ``host``.

    A patch of shapes closes the operand, an overlay or host only if it says so.  A closing patch of values alone (not an
    overlay's) leaves the rest as suggestions; any other drops what was only suggested and is not given again.
    An open host replaces the values of an open operand and loosens none.
    """
    theirs = patch.select(F.col("left_iri").alias("p_key"), *[F.col(c).alias(f"p_{c}") for c in COLUMNS])
    both = base.join(theirs, base["left_iri"] == F.col("p_key"), "full")
    blank = {c: F.array().cast(NONE) for c in LISTS} | {c: F.lit(False) for c in FLAGS}
    fill = lambda c, side: F.coalesce(F.col(side + c), blank[c]) if c in blank else F.col(side + c)
    wide = both.select(F.coalesce("left_iri", "p_key").alias("left_iri"), *[fill(c, "").alias(c) for c in COLUMNS], *[fill(c, "p_").alias(f"p_{c}") for c in COLUMNS])

    given = {"operators": _some("p_operators"), "values": _some("p_values") | _some("p_literals"), "units": _some("p_units"), "datatype": F.col("p_datatype").isNotNull(), "lexical": _lexical("p_lexical")}
    anything = given["operators"] | given["values"] | given["units"] | given["datatype"] | given["lexical"]
    values_alone = given["values"] & ~given["operators"] & ~given["units"] & ~given["datatype"] & ~given["lexical"]
    closed, shuts = F.col("closed"), {"shapes": anything, "overlay": F.col("p_closed") & anything, "host": F.col("p_closed") & given["values"]}[source]
    binds_others = closed & ~F.col("values_only")
    suggested = ~closed & (_some("operators") | _some("units") | F.col("datatype").isNotNull())
    alone = shuts & values_alone if source != "overlay" else F.lit(False)
    if source == "host":
        takes = {k: F.lit(False) for k in given} | {"values": given["values"] & (F.col("p_closed") | ~closed)}
    elif source == "overlay":  # an overlay says nothing of forms
        takes = given | {"lexical": given["lexical"] & shuts}
    else:
        takes = given
    drops = shuts & ~alone & ~binds_others
    none = F.array().cast(NONE)
    new = {
        "operators": F.when(takes["operators"], F.col("p_operators")).when(drops, none).otherwise(F.col("operators")),
        "units": F.when(takes["units"], F.col("p_units")).when(drops, none).otherwise(F.col("units")),
        "datatype": F.when(takes["datatype"], F.col("p_datatype")).when(~drops, F.col("datatype")),
        "lexical": F.when(takes["lexical"], F.col("p_lexical")).otherwise(F.col("lexical")),
        "values": F.when(takes["values"], F.col("p_values")).when(drops & ~closed, none).otherwise(F.col("values")),
        "literals": F.when(takes["values"], none if source == "host" else F.col("p_literals")).when(drops & ~closed, none).otherwise(F.col("literals")),
        "values_exact": F.when(takes["values"], F.lit(True) if source == "host" else F.col("p_values_exact")).otherwise(F.col("values_exact")),
        "closed": closed | shuts | (F.col("p_closed") if source == "overlay" else F.lit(False)),
        "plural": F.col("plural") | F.col("p_plural") if source == "overlay" else F.col("plural"),
    }
    # A host over an open operand closes the values alone even where there is nothing else to keep.
    only = (alone & ~closed) if source == "host" else (alone & suggested)
    new["values_only"] = F.when(only, True).when(alone, F.col("values_only")).when(shuts, False).otherwise(F.col("values_only"))
    for facet in ("operators", "values", "units", "datatype", "lexical"):
        new[f"src_{facet}"] = F.when(takes[facet], F.lit(source)).otherwise(F.col(f"src_{facet}"))
    return wide.select("left_iri", *[new[c].alias(c) for c in COLUMNS])


def layered(profile: DataFrame, overlay: DataFrame | None = None, shapes: DataFrame | None = None, host: DataFrame | None = None) -> DataFrame:
    """All four layers in their order; each with left_iri and the facets that it gives."""
    out = facets(profile, "profile")
    for source, patch in (("overlay", overlay), ("shapes", shapes), ("host", host)):
        if patch is not None:
            out = layer(out, facets(patch, source), source)
    return out


def hint_tables(layers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Layered hints as the tables that the hint rules join: hints, operators, values, units."""
    hints = layers.select(
        "left_iri", "datatype", F.col("lexical.low").alias("lo"), F.col("lexical.high").alias("hi"), F.col("lexical.pattern").alias("pattern"), "closed", "values_only", "values_exact"
    )
    listed = lambda c, literal: layers.select("left_iri", F.posexplode(c).alias("ix", "value"), F.lit(literal).alias("literal"))
    operators = layers.select("left_iri", F.explode("operators").alias("op"))
    return hints, operators, listed("values", False).unionByName(listed("literals", True)), layers.select("left_iri", F.explode("units").alias("unit"))
