"""Queries over profile terms in words, with terms and labels derived from parts and uses from lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.corpus import Corpus
from clausework.operators import hints, wording

#: Kinds by number, for terms and for uses.
KINDS = "CASE {0} % 6 WHEN 0 THEN 'Action' WHEN 1 THEN 'LeftOperand' WHEN 2 THEN 'RightOperand' WHEN 3 THEN 'Operator' WHEN 4 THEN 'Unit' ELSE 'PolicyClass' END"
TERMS = f"""
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS profile_id, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS load_order, p_partkey AS term_ix,
  concat('urn:x://t#t', cast(p_partkey AS string)) AS iri, {KINDS.format("p_size")} AS kind, p_partkey % 10 = 0 AS deprecated FROM {{part}}
UNION ALL SELECT 'b', 2, p_partkey, concat('urn:x://t#t', cast(p_partkey AS string)), 'Unit', true FROM {{part}} WHERE p_partkey % 6 = 0
"""
LABEL = "CASE p_partkey % 5 WHEN 0 THEN 'Has part ' WHEN 1 THEN 'Near ' WHEN 2 THEN 'are like ' WHEN 3 THEN 'The thing ' ELSE 'Other ' END"
TEXTS = f"""
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS profile_id, concat('urn:x://t#t', cast(p_partkey AS string)) AS iri, 'label' AS p, concat({LABEL}, cast(p_partkey AS string)) AS text, 'en' AS lang, 0 AS ix FROM {{part}} WHERE p_partkey % 7 <> 0
UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END, concat('urn:x://t#t', cast(p_partkey AS string)), 'label', 'autre', 'fr', 1 FROM {{part}} WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'b', concat('urn:x://t#t', cast(p_partkey AS string)), 'label', 'a label of a later profile', 'en', 0 FROM {{part}} WHERE p_partkey % 6 = 0
UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END, concat('urn:x://t#t', cast(p_partkey AS string)), CASE WHEN p_partkey % 3 = 0 THEN 'note' ELSE 'definition' END, p_name, NULL, 0 FROM {{part}}
"""
USES = f"SELECT l_orderkey, l_linenumber, concat('x:t', cast(l_partkey AS string)) AS written, concat('urn:x://t#t', cast(l_partkey AS string)) AS iri, {KINDS.format('l_linenumber')} AS kind, 'count' AS left, 'Number' AS shape, l_suppkey % 2 = 0 AS plural FROM {{lineitem}}"
UP = "concat('urn:x://t#t', cast(cast(floor(p_partkey / 2) AS bigint) AS string))"
LINKS = f"""
SELECT concat('urn:x://t#t', cast(p_partkey AS string)) AS child, {UP} AS parent, 'includedIn' AS predicate, 1 AS ix FROM {{part}} WHERE p_partkey % 2 = 0
UNION ALL SELECT concat('urn:x://t#t', cast(p_partkey AS string)), {UP}, 'broader', 0 FROM {{part}} WHERE p_partkey % 4 = 0
UNION ALL SELECT concat('urn:x://t#t', cast(p_partkey AS string)), 'urn:x://t#otherThing', 'broader', 1 FROM {{part}} WHERE p_partkey % 3 = 0
UNION ALL SELECT concat('urn:x://t#t', cast(p_partkey AS string)), concat('urn:x://t#t', cast(p_partkey AS string)), 'implies', 0 FROM {{part}} WHERE p_partkey % 5 = 0
"""
PATTERNS = r"""SELECT p_partkey, p_brand AS value, CASE p_partkey % 5 WHEN 0 THEN '^brand.\\d' WHEN 1 THEN 'B\\w+\\W[1-3]+$' WHEN 2 THEN 'BRAND' WHEN 3 THEN '\\S\\s' ELSE '[\\d]{{2}}' END AS pattern, CASE WHEN p_partkey % 2 = 0 THEN 'i' END AS flags FROM {part}"""


def _named(c: Corpus) -> DataFrame:
    return wording.declared(c.spark.sql(TERMS, part=c.part), c.spark.sql(TEXTS, part=c.part), ["en-GB"])


def _glosses(c: Corpus) -> DataFrame:
    uses = c.spark.sql(USES, lineitem=c.lineitem).select("written", "iri", "kind").distinct()
    titles = c.spark.createDataFrame([("a", "Profile A")], "profile_id string, title string")
    shown = lambda x: F.array_join(F.transform(x, lambda t: F.concat_ws("=", t["iri"], t["label"])), " ")
    return wording.gloss(uses, _named(c), c.spark.sql(LINKS, part=c.part), titles).withColumns({n: shown(F.col(n)) for n in ("broader", "implies")})


def _mismatches(c: Corpus) -> DataFrame:
    rows = c.spark.sql(PATTERNS, part=c.part)
    return rows.select("p_partkey", "value", hints.pattern_mismatch(F.col("value"), F.col("pattern"), F.col("flags")).alias("mismatch"))


QUERIES = {
    "p10_profile_wording": lambda c: wording.wording(c.spark.sql(USES, lineitem=c.lineitem), _named(c)).select("l_orderkey", "l_linenumber", "written", "kind", "phrase"),
    "v6_glossary_entries": _glosses,
    "c16_pattern_flags": _mismatches,
}

NAMED = f"""WITH part2 AS (SELECT p_partkey AS k, p_size, p_name, CASE WHEN p_partkey % 7 = 0 THEN 't' || p_partkey ELSE {LABEL} || p_partkey END AS label FROM part),
  t AS (SELECT *, 'urn:x://t#t' || k AS iri, {KINDS.format("p_size")} AS own FROM part2)"""
ORACLES = {
    "p10_profile_wording": f"""{NAMED}, u AS (SELECT l.*, t.*, {KINDS.format("l_linenumber")} AS kind, 't' || l_partkey AS loc, own = {KINDS.format("l_linenumber")} OR (k % 6 = 0 AND k % 2 <> 0 AND l_linenumber % 6 = 4) AS fits, lower(label[1]) || label[2:] AS low,
        CASE WHEN l_suppkey % 2 = 0 THEN 'are ' ELSE 'is ' END AS be FROM lineitem l LEFT JOIN t ON k = l_partkey)
      SELECT l_orderkey, l_linenumber, 'x:t' || l_partkey AS written, kind, CASE kind WHEN 'Action' THEN CASE WHEN fits THEN low ELSE loc END WHEN 'LeftOperand' THEN CASE WHEN fits AND low LIKE 'the %' THEN low WHEN fits THEN 'the ' || low ELSE 'the ' || loc END
        WHEN 'Operator' THEN CASE WHEN NOT coalesce(fits, false) THEN 'is related by ' || loc || ' to' WHEN low LIKE 'has %' AND l_suppkey % 2 = 0 THEN 'have' || low[4:] WHEN low LIKE 'has %' OR low LIKE 'are %' THEN low ELSE be || low END
        WHEN 'Unit' THEN coalesce(label, loc) WHEN 'RightOperand' THEN CASE WHEN fits THEN low END ELSE CASE WHEN fits THEN label END END AS phrase FROM u""",
    "v6_glossary_entries": f"""{NAMED}, u AS (SELECT DISTINCT l_partkey, {KINDS.format("l_linenumber")} AS kind FROM lineitem)
      SELECT 'x:t' || c.k AS written, c.iri, c.own AS kind, c.label, CASE WHEN c.k % 3 <> 0 THEN c.p_name END AS definition, CASE WHEN c.k % 3 = 0 THEN c.p_name END AS note,
        concat_ws(' ', CASE WHEN c.k % 2 = 0 THEN 'urn:x://t#t' || c.k // 2 || '=' || coalesce(p.label, 't' || c.k // 2) END, CASE WHEN c.k % 3 = 0 THEN 'urn:x://t#otherThing=other thing' END) AS broader,
        CASE WHEN c.k % 5 = 0 THEN c.iri || '=' || c.label ELSE '' END AS implies, CASE WHEN c.k % 2 = 0 THEN 'Profile A' END AS profile, c.k % 10 = 0 AS deprecated
      FROM u JOIN t c ON c.k = l_partkey LEFT JOIN t p ON p.k = c.k // 2""",
    "c16_pattern_flags": r"""SELECT p_partkey, p_brand AS value, NOT CASE p_partkey % 5 WHEN 0 THEN p_partkey % 2 = 0 AND regexp_matches(p_brand, '(?i)^brand.[0-9]') WHEN 1 THEN regexp_matches(p_brand, 'B[A-Za-z0-9_]+[^A-Za-z0-9_][1-3]+$')
      WHEN 2 THEN p_brand LIKE '%BRAND%' OR (p_partkey % 2 = 0 AND p_brand ILIKE '%BRAND%') WHEN 3 THEN p_brand LIKE '% %' ELSE regexp_matches(p_brand, '[0-9]{2}') END AS mismatch FROM part""",
}
