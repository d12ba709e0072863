"""Profile terms in words: phrases by a profile's own labels, and glossary entries.

``terms``: profile_id, load_order, iri, kind, deprecated; ``texts``: profile_id, iri, p (label, definition,
note), text, lang, ix.  Of several profiles that declare a term the one that is loaded first speaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions.names import action_phrase, humanise, local_name, operand_phrase, operator_phrase
from clausework.functions.wording import article, label_in_sentence
from clausework.model import ODRL
from clausework.operators.vocabulary import best_language

# Verbs that a label may open with, for one and for several.
VERBS = {"is": "are", "has": "have", "does": "do", "contains": "contain", "matches": "match"}


def verb_phrase(label: Column, plural: Column) -> Column:
    """An operator's label after its subject: a verb in front agrees in number, ``are`` stays, all else follows ``is``."""
    first = F.substring_index(label, " ", 1)
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    rest = F.substr(label, F.length(first) + 1)
    said = F.when(plural, F.concat(verbs[first], rest)).otherwise(label)
    return F.when(first.isin(*VERBS), said).when(first == "are", label).otherwise(F.concat(F.when(plural, "are ").otherwise("is "), label))


def declared(terms: DataFrame, texts: DataFrame, languages: list[str]) -> DataFrame:
    """iri, profile_id, kinds, deprecated, label, definition, note: each term as its first loaded profile has it, texts in the preferred language.

    A term without a label is called by its local name.
    """
    order = F.struct("load_order", "profile_id")
    first = terms.groupBy("iri").agg(F.min(order)["profile_id"].alias("profile_id"))
    kinds = terms.join(first, ["iri", "profile_id"]).groupBy("iri", "profile_id").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.min_by("kind", F.struct("term_ix", "kind")).alias("first_kind"), F.bool_or("deprecated").alias("deprecated")
    )
    said = best_language(texts, ["profile_id", "iri", "p"], languages)
    told = said.groupBy("profile_id", "iri").agg(*[F.max(F.when(F.col("p") == p, F.col("text"))).alias(p) for p in ("label", "definition", "note")])
    named = kinds.join(told, ["profile_id", "iri"], "left")
    return named.withColumn("label", F.coalesce("label", humanise(local_name(F.col("iri")))))


def wording(uses: DataFrame, named: DataFrame) -> DataFrame:
    """``uses`` (written, iri, kind, and for operators left, shape, plural) with ``phrase``: by the profile's label, else built in.

    ``named`` is what ``declared`` returns.  ODRL's own terms keep their built-in phrases whatever a profile
    says, and so do terms used as a kind that they are not; a unit is called by its label as any kind.  Values,
    policy classes and party functions have no built-in phrase (null).
    """
    low = F.col("low")
    by = (
        named.where(~F.col("iri").startswith(ODRL)).select("iri", F.col("label").alias("own_label"), F.col("kinds").alias("own_kinds"), label_in_sentence(F.col("label")).alias("low"))
        .withColumns({"noun": article(low), "one": verb_phrase(low, F.lit(False)), "several": verb_phrase(low, F.lit(True))})
    )
    wide = uses.join(by, "iri", "left")
    kind, written = F.col("kind"), F.col("written")
    fits = F.coalesce(F.array_contains("own_kinds", kind), F.lit(False))
    verb = F.when(F.coalesce("plural", F.lit(False)), F.col("several")).otherwise(F.col("one"))
    phrase = (
        F.when(kind == "Action", F.when(fits, low).otherwise(action_phrase(written)))
        .when(kind == "LeftOperand", F.when(fits, F.col("noun")).otherwise(operand_phrase(written)))
        .when(kind == "Operator", F.when(fits, verb).otherwise(operator_phrase(F.col("left"), written, F.col("shape"))))
        .when(kind == "Unit", F.coalesce("own_label", humanise(local_name(written))))
        .when(kind == "RightOperand", F.when(fits, low))
        .otherwise(F.when(fits, F.col("own_label")))
    )
    return wide.withColumn("phrase", phrase).drop("own_label", "own_kinds", "low", "noun", "one", "several")


def gloss(uses: DataFrame, named: DataFrame, links: DataFrame, titles: DataFrame) -> DataFrame:
    """written, iri, kind, label, definition, note, broader, implies, profile, deprecated: an entry for each use (written, iri, kind) of a profile's term.

    ``links``: child, parent, predicate (includedIn, broader, implies), ix; ``titles``: profile_id, title.
    ``broader`` names what the term is included in before what is broader, each IRI once with its label.
    A term used as a kind that it is not is listed as the first kind it has; uses of no known term have no entry.
    Terms are joined and gathered by IRI before the uses are met, so a term in many policies costs nothing more.
    """
    labels = named.select(F.col("iri").alias("parent"), F.col("label").alias("parent_label"))
    rank = F.when(F.col("predicate") == "includedIn", 0).when(F.col("predicate") == "broader", 1)
    once = links.withColumn("up", F.col("predicate") != "implies").groupBy("child", "up", "parent").agg(F.min(F.struct(rank.alias("rank"), "ix")).alias("at"))
    said = once.join(labels, "parent", "left").withColumn("name", F.coalesce("parent_label", humanise(local_name(F.col("parent")))))
    entry = F.struct("at", F.struct(F.col("parent").alias("iri"), F.col("name").alias("label")).alias("term"))
    gathered = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, entry))), lambda x: x["term"])
    above = said.groupBy(F.col("child").alias("iri")).agg(gathered(F.col("up")).alias("broader"), gathered(~F.col("up")).alias("implies"))
    none = F.array().cast("array<struct<iri:string,label:string>>")
    full = named.join(above, "iri", "left").join(titles, "profile_id", "left").withColumns({c: F.coalesce(c, none) for c in ("broader", "implies")})
    kind = F.when(F.array_contains("kinds", F.col("kind")), F.col("kind")).otherwise(F.col("first_kind"))
    return uses.select("written", "iri", "kind").join(full, "iri").select(
        "written", "iri", kind.alias("kind"), "label", "definition", "note", "broader", "implies", F.col("title").alias("profile"), "deprecated"
    )
