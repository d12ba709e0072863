"""Queries for readings, names and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.corpus import Corpus, ctes
from clausework.functions import names, paths
from clausework.jobs.rules import M, order_sql
from clausework.model import FEATURES, OPERAND_PHRASES
from clausework.operators import catalog, conditions, inherit, prose, resolve
from clausework.sources.shared import cut

KEY = ["doc_id", "policy_ix"]


def _sources(c: Corpus) -> DataFrame:
    """Documents belong to one of five sources."""
    return c.policies.select(*KEY, F.concat(F.lit("source-"), (F.col("doc_id") % 5).cast("string")).alias("source"))


def _texts(c: Corpus) -> DataFrame:
    said = lambda x: prose.literal_text(F.col("right_kind"), x, F.col("datatype"))
    values = F.when(F.col("n_values") > 1, F.array(said(F.col("raw")), said(F.concat("raw", F.lit("x"))))).otherwise(F.array(said(F.col("raw"))))
    return c.constraints.withColumn("vals", values).select(
        "doc_id", "policy_ix", "rule_ix", "con_ix", "path", "logical_op",
        prose.constraint_text(F.col("lft"), F.col("operator"), F.col("vals"), F.col("raw"), F.col("datatype"), F.col("right_kind"), F.col("unit")).alias("text"),
    )


def _features(c: Corpus) -> DataFrame:
    found = catalog.features(catalog.policy_keys(c.policies, c.rules, c.constraints), catalog.feature_table(c.spark))
    return found.join(_sources(c), KEY)


def _coverage(c: Corpus) -> DataFrame:
    return catalog.coverage(_features(c), catalog.feature_table(c.spark), _sources(c))


def _entries(c: Corpus) -> DataFrame:
    loaded = resolve.covered_profiles(c.policies, c.profiles).select(*KEY, "covered")
    return _sources(c).join(loaded, KEY).join(c.policies.select(*KEY, "uid"), KEY).select(
        "source", (~F.col("covered")).alias("incomplete"), F.when(F.col("uid").isNull(), 1).otherwise(0).alias("n_warnings")
    )


def _intro(c: Corpus) -> DataFrame:
    heading, intro = prose.policy_intro(F.col("kind"), F.col("assigner"), F.col("assignee"))
    return c.policies.select(*KEY, heading.alias("heading"), intro.alias("intro"))


def _sentences(c: Corpus) -> DataFrame:
    parts = prose.effective_parts(c.rules, c.policies)
    return parts.select(*KEY, "path", prose.rule_sentence(F.col("list"), F.col("assigner"), F.col("assignee"), F.col("target"), F.col("action")).alias("sentence"))


# Parties with a function of their own: every line's part is one, every third has two, every fourth a contractor.
PARTIES = """
SELECT doc_id, policy_ix, rule_ix, CASE l_partkey % 5 WHEN 0 THEN 'attributedParty' WHEN 1 THEN 'compensatedParty' WHEN 2 THEN 'informedParty' WHEN 3 THEN 'contractedParty' ELSE 'trackingParty' END AS function,
  0 AS ord, concat('p', cast(l_partkey AS string)) AS name, l_partkey % 10 = 1 AS refined FROM {lines}
UNION ALL SELECT doc_id, policy_ix, rule_ix, CASE l_partkey % 5 WHEN 0 THEN 'attributedParty' WHEN 1 THEN 'compensatedParty' WHEN 2 THEN 'informedParty' WHEN 3 THEN 'contractedParty' ELSE 'trackingParty' END, 1, 'x', false FROM {lines} WHERE l_partkey % 3 = 0
UNION ALL SELECT doc_id, policy_ix, rule_ix, 'contractedParty', 2, 'y', false FROM {lines} WHERE l_partkey % 4 = 0
"""
VERBS = """
SELECT doc_id, policy_ix, rule_ix, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 'use' ELSE CASE l_partkey % 5 WHEN 0 THEN 'attribute' WHEN 1 THEN 'compensate' WHEN 2 THEN 'inform' WHEN 3 THEN 'use' ELSE 'acceptTracking' END END AS verb,
  CASE WHEN l_partkey % 6 = 0 THEN '' ELSE concat(' t', cast(l_suppkey AS string)) END AS about FROM {lines}
"""


def _party_functions(c: Corpus) -> DataFrame:
    rules = c.spark.sql(VERBS, lines=c.lines).select(*KEY, "rule_ix", "verb", F.col("verb").alias("does"), F.col("about").alias("on"))
    return prose.party_functions(rules, c.spark.sql(PARTIES, lines=c.lines), [*KEY, "rule_ix"])


def _notes(c: Corpus) -> DataFrame:
    """Policies with their parents, the rules they have or inherit and the ancestors that are not there."""
    links = cut(inherit.inherit_links(c.policies, c.inherits, c.prefixes), "links")
    above = cut(inherit.lineages(links), "above").select(*KEY, F.col("ancestor_ix").alias("at"))
    reach = c.policies.select(*KEY, F.col("policy_ix").alias("at")).unionByName(above)
    own = c.rules.groupBy("doc_id", F.col("policy_ix").alias("at")).agg(F.count("*").alias("n"))
    counts = reach.join(own, ["doc_id", "at"]).groupBy(*KEY).agg(F.sum("n").alias("n_rules"))
    gone = links.where("parent_ix is null").select("doc_id", F.col("policy_ix").alias("at"), F.col("parent").alias("name"))
    missing = reach.join(gone, ["doc_id", "at"]).groupBy(*KEY).agg(F.sort_array(F.collect_set("name")).alias("missing"), F.bool_and(F.col("at") == F.col("policy_ix")).alias("missing_are_parents"))
    parents = c.inherits.groupBy(*KEY).agg(F.sort_array(F.collect_list("parent")).alias("parents"))
    none = F.array().cast("array<string>")
    known = c.policies.select(*KEY, "profile", "conflict").join(counts, KEY, "left").join(missing, KEY, "left").join(parents, KEY, "left")
    return prose.policy_notes(
        known.select(*KEY, none.alias("metadata"), F.array_compact(F.array("profile")).alias("profiles"), "conflict", F.coalesce("parents", none).alias("parents"),
                     F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.coalesce("missing", none).alias("missing"), "missing_are_parents"), KEY)


def _durations(c: Corpus) -> DataFrame:
    """Durations made of line quantities, right and wrong ones."""
    q = (F.col("l_quantity").cast("int")).cast("string")
    n = (F.col("l_linenumber")).cast("string")
    made = F.concat(
        F.when(F.col("l_partkey") % 5 == 0, "-").otherwise(""), F.lit("P"), F.when(F.col("l_partkey") % 2 == 0, F.concat(n, F.lit("Y"))).otherwise(""),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(q, F.lit("M"))).otherwise(""), F.when(F.col("l_partkey") % 7 == 0, "T").otherwise(""),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(q, F.lit("H"))).otherwise(F.concat(F.lit("0"), n, F.lit("D"))),
    )
    return c.lineitem.select(made.alias("value")).distinct()


def _names(c: Corpus) -> DataFrame:
    uses = resolve.expand_terms(resolve.term_uses(c.policies, c.rules, c.constraints), c.prefixes, c.profiles)
    both = uses.select(F.col("written").alias("term")).unionByName(uses.select(F.col("iri").alias("term"))).distinct()
    t = F.col("term")
    return both.select(
        "term", names.local_name(t).alias("local"), names.short_iri(t).alias("short"), names.humanise(names.local_name(t)).alias("human"), names.namespace(t).alias("ns"),
        names.trim_iri(t).alias("trimmed"), names.iri_ok(t).alias("ok"), names.action_phrase(t).alias("action"), names.operand_phrase(t).alias("operand"),
    )


def _glossary(c: Corpus) -> DataFrame:
    uses = resolve.expand_terms(resolve.term_uses(c.policies, c.rules, c.constraints), c.prefixes, c.profiles)
    return prose.glossary(uses.withColumn("ord", paths.slot_key(F.col("path"), F.col("slot"))), c.terms)


def _mentions(c: Corpus) -> DataFrame:
    uses = c.rules.select(*KEY, F.explode(F.array("assigner", "assignee", "target")).alias("written"), F.col("rule_ix").alias("ord"))
    return prose.mentions(uses)


def _entries_by_status(c: Corpus) -> DataFrame:
    e = _entries(c)
    status = F.when(F.col("incomplete"), "incomplete").when(F.col("n_warnings") > 0, "with warnings").otherwise("complete")
    return e.groupBy("source", status.alias("status")).agg(F.count("*").alias("n"))


def _links(c: Corpus) -> DataFrame:
    status = c.pages.select("url", F.when(F.col("page_id") % 3 == 0, 404).otherwise(200).alias("status"))
    return catalog.live_links(c.pages.select("url"), status)


QUERIES = {
    "p1_policy_intro": _intro,
    "p4_effective_parts": lambda c: prose.effective_parts(c.rules, c.policies).select(*KEY, "path", "assigner", "assignee", "target", "action"),
    "p2_policy_notes": _notes,
    "p5_party_functions": _party_functions,
    "p6_rule_sentences": _sentences,
    "p7_constraint_text": lambda c: _texts(c).select(*KEY, "path", "text"),
    "p8_follow_up_labels": lambda c: c.rules.select("list").distinct().join(
        c.spark.createDataFrame([("duty",), ("remedy",), ("consequence",)], "follow string"), F.lit(True)
    ).select("list", "follow", prose.follow_up_label(F.col("list"), F.col("follow")).alias("label")),
    "g13_condition_lines": lambda c: conditions.condition_lines(conditions.condition_nodes(_texts(c), KEY), KEY),
    "e5_glossary": _glossary,
    "e5_glossary_full": _glossary,
    "e6_mentions": _mentions,
    "names_of_terms": _names,
    "h8_duration_words": lambda c: _durations(c).select("value", names.duration_words(F.col("value")).alias("words"), names.xsd_valid(F.lit("xsd:duration"), F.col("value")).alias("lexical")),
    "h9_value_shapes": lambda c: c.constraints.where("right_kind = 'literal'").select("raw", "datatype").distinct().select(
        "raw", "datatype", names.value_shape(F.col("raw"), F.col("datatype")).alias("shape"), names.xsd_valid(F.col("datatype"), F.col("raw")).alias("valid"), names.quoted(F.col("raw")).alias("quoted")
    ),
    "h12_page_urls": lambda c: c.pages.select("page_id", F.array_join(names.http_urls(F.concat(F.lit("see "), F.col("url"), F.lit(", or ("), F.col("url"), F.lit(")."))), " ").alias("urls")),
    "h27_language_ranges": lambda c: c.documents.select("lang").distinct().select("lang", F.array_join(names.shorter_ranges(F.concat("lang", F.lit("-XX-x-"), "lang")), " ").alias("ranges")),
    "a4_html_blocks": lambda c: catalog.html_blocks(c.pages),
    "d1_features": lambda c: _features(c).groupBy("feature").agg(F.count("*").alias("n")),
    "d2_coverage": _coverage,
    "d3_source_totals": lambda c: catalog.source_totals(_entries(c)),
    "d4_coverage_gaps": lambda c: catalog.coverage_gaps(_coverage(c).withColumn("n", F.when((F.col("source") == "source-0") & (F.col("feature") < "c"), 0).otherwise(F.col("n"))), "source-0"),
    "b11_reading_status": _entries_by_status,
    "c19_live_links": _links,
}

_LOCAL = """CASE WHEN {0} LIKE 'http://www.w3.org/ns/odrl/2/%' THEN substr({0}, 29) WHEN {0} LIKE 'odrl:%' THEN substr({0}, 6)
  WHEN {0} LIKE '%://%' THEN regexp_extract({0}, '[^#/]*$') ELSE regexp_extract({0}, '[^:]*$') END"""
_HUMAN = "lower(translate(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '-_', '  '))"


def local(x: str) -> str:
    return _LOCAL.format(x)


def human(x: str) -> str:
    return _HUMAN.format(x)


_OPERANDS = "CASE " + local("{0}") + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPERAND_PHRASES.items()) + " ELSE 'the ' || " + human("(" + local("{0}") + ")") + " END"
_ACTION = "CASE " + local("{0}") + " WHEN 'grantUse' THEN 'grant use of' ELSE " + human("(" + local("{0}") + ")") + " END"
_QUOTED = """CASE WHEN NOT regexp_matches({0}, '\\s') AND ({0} LIKE '%:%' OR TRY_CAST({0} AS DOUBLE) IS NOT NULL OR regexp_matches({0}, '^.{{4}}-.{{2}}-.{{2}}')) THEN {0} ELSE '"' || {0} || '"' END"""
_FEATURES = ", ".join(f"('{g}', '{f}', {i})" for i, (g, f) in enumerate(FEATURES))
TEXTS = f"""{M}, worded AS (SELECT c.*, replace(operator, 'odrl:', '') AS o,
    CASE right_kind WHEN 'missing' THEN 'an unspecified value' WHEN 'iri' THEN raw || coalesce(' ' || split_part(unit, ':', -1), '')
      ELSE CASE WHEN datatype IS NULL THEN {_QUOTED.format("raw")} ELSE raw END || CASE WHEN n_values > 1 THEN CASE WHEN operator IN ('isAnyOf', 'isNoneOf') THEN ' or ' ELSE ' and ' END || CASE WHEN datatype IS NULL THEN {_QUOTED.format("(raw || 'x')")} ELSE raw || 'x' END ELSE '' END
        || coalesce(' ' || split_part(unit, ':', -1), '') END AS rgt,
    lft = 'dateTime' AND right_kind = 'literal' AND (datatype IS NULL OR datatype = 'xsd:date') AS day FROM constraints c),
texts AS (SELECT doc_id, policy_ix, rule_ix, con_ix, path, logical_op, CASE WHEN lft IS NULL THEN 'an incomplete constraint holds' ELSE
    CASE lft WHEN 'dateTime' THEN 'the date and time' WHEN 'count' THEN 'the number of times used' WHEN 'odrl:percentage' THEN 'the percentage' WHEN 'ex:purpose' THEN 'the purpose' ELSE 'the region' END || ' ' ||
    CASE WHEN lft = 'dateTime' AND o = 'gt' THEN CASE WHEN day THEN 'are after the end of' ELSE 'are after' END
      WHEN lft = 'dateTime' AND o = 'lteq' THEN CASE WHEN day THEN 'are on or before the end of' ELSE 'are on or before' END
      ELSE CASE WHEN lft = 'dateTime' THEN 'are ' ELSE 'is ' END || CASE o WHEN 'eq' THEN 'equal to' WHEN 'neq' THEN 'not equal to' WHEN 'gt' THEN 'greater than' WHEN 'lteq' THEN 'at most'
        WHEN 'isAnyOf' THEN 'any of' WHEN 'isNoneOf' THEN 'none of' ELSE 'related by near to' END END || ' ' || rgt END AS text FROM worded)"""
PARTS = f"""{M}, parts AS (SELECT r.doc_id, r.policy_ix, path, list, coalesce(r.assigner, p.assigner) AS assigner, coalesce(r.assignee, p.assignee) AS assignee,
  coalesce(r.target, p.target) AS target, coalesce(r.action, p.action) AS action FROM rules r JOIN policies p USING (doc_id, policy_ix))"""
KEYS = f"""{M}, keys AS (SELECT doc_id, policy_ix, kind AS f FROM policies
  {" ".join(f"UNION SELECT doc_id, policy_ix, '{k}' FROM policies WHERE {k} IS NOT NULL" for k in ("assigner", "assignee", "conflict", "profile"))}
  UNION SELECT doc_id, policy_ix, 'inheritFrom' FROM policies WHERE parent_ix IS NOT NULL UNION SELECT doc_id, policy_ix, list FROM rules
  {" ".join(f"UNION SELECT doc_id, policy_ix, '{k}' FROM rules WHERE {k} IS NOT NULL" for k in ("assigner", "assignee"))}
  UNION SELECT doc_id, policy_ix, 'constraint' FROM constraints UNION SELECT doc_id, policy_ix, logical_op FROM constraints
  UNION SELECT doc_id, policy_ix, 'unit' FROM constraints WHERE unit IS NOT NULL UNION SELECT doc_id, policy_ix, 'dataType' FROM constraints WHERE datatype IS NOT NULL),
table_f AS (SELECT * FROM (VALUES {_FEATURES}) AS t(grp, feature, ix)),
feats AS (SELECT DISTINCT doc_id, policy_ix, feature, 'source-' || (doc_id % 5) AS source FROM keys JOIN table_f ON feature = f),
cov AS (SELECT grp, feature, ix, s.source, count(k.doc_id) AS n FROM table_f CROSS JOIN (SELECT DISTINCT 'source-' || (doc_id % 5) AS source FROM policies) s LEFT JOIN feats k USING (feature, source) GROUP BY ALL)"""
ENTRIES = f"""{M}, entries AS (SELECT 'source-' || (doc_id % 5) AS source, (doc_id, policy_ix) IN (SELECT (doc_id, policy_ix) FROM gaps) AS incomplete, uid IS NULL AS warned FROM policies)"""
_DURATION_VALUE = """concat(CASE WHEN l_partkey % 5 = 0 THEN '-' ELSE '' END, 'P', CASE WHEN l_partkey % 2 = 0 THEN l_linenumber || 'Y' ELSE '' END,
  CASE WHEN l_partkey % 3 = 0 THEN l_quantity::INT || 'M' ELSE '' END, CASE WHEN l_partkey % 7 = 0 THEN 'T' ELSE '' END, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity::INT || 'H' ELSE '0' || l_linenumber || 'D' END)"""

ORACLES = {
    "p1_policy_intro": f"""{M} SELECT doc_id, policy_ix, CASE coalesce(kind, 'Set') WHEN 'Set' THEN 'Policy set' WHEN 'Offer' THEN 'Offer' WHEN 'Agreement' THEN 'Agreement' ELSE 'Policy' END AS heading,
      CASE coalesce(kind, 'Set') WHEN 'Set' THEN 'A set of rules' WHEN 'Offer' THEN 'An offer' || coalesce(' made by ' || assigner, '') WHEN 'Agreement' THEN 'An agreement' ELSE 'A policy of type ' || kind END ||
      CASE WHEN kind = 'Offer' THEN coalesce(', addressed to ' || assignee, '') WHEN assigner IS NOT NULL AND assignee IS NOT NULL THEN ' between ' || assigner || ' (assigner) and ' || assignee || ' (assignee)'
        WHEN assigner IS NOT NULL THEN ' from ' || assigner || ' (assigner)' WHEN assignee IS NOT NULL THEN ' for ' || assignee || ' (assignee)' ELSE '' END || '.' AS intro FROM policies""",
    "p4_effective_parts": f"{PARTS} SELECT doc_id, policy_ix, path, assigner, assignee, target, action FROM parts",
    "p2_policy_notes": f"""{M}, reach AS (SELECT doc_id, policy_ix, policy_ix AS at_ix FROM policies UNION ALL SELECT doc_id, policy_ix, ancestor_ix FROM (SELECT DISTINCT doc_id, policy_ix, ancestor_ix FROM walk)),
      n AS (SELECT x.doc_id, x.policy_ix, count(r.rule_ix) AS n FROM reach x LEFT JOIN rules r ON r.doc_id = x.doc_id AND r.policy_ix = x.at_ix GROUP BY ALL),
      gone AS (SELECT x.doc_id, x.policy_ix, bool_and(x.at_ix = x.policy_ix) AS near, list_sort(list(DISTINCT l.parent)) AS ms FROM reach x JOIN links_in l ON l.doc_id = x.doc_id AND l.policy_ix = x.at_ix WHERE l.parent_ix IS NULL GROUP BY ALL),
      every AS (SELECT doc_id, policy_ix, 0 AS k, 'Written to the profile ' || profile || '.' AS note FROM policies
        UNION ALL SELECT doc_id, policy_ix, 1, CASE conflict WHEN 'perm' THEN 'If a permission and a prohibition conflict, the permission wins.' WHEN 'prohibit' THEN 'If a permission and a prohibition conflict, the prohibition wins.' WHEN 'ex:newest' THEN 'Conflicts are resolved by the strategy newest.' END FROM policies
        UNION ALL SELECT i.doc_id, i.policy_ix, 2, CASE WHEN n > 0 THEN 'Inherits the rules of ' || i.parent || '.' WHEN near IS NOT NULL THEN 'All of its rules come from the ' || CASE WHEN near THEN 'parent' ELSE 'ancestor' END || CASE WHEN len(ms) = 1 THEN ' policy ' || ms[1] || ', which is' ELSE ' policies ' || array_to_string(ms[:-2], ', ') || ' and ' || ms[-1] || ', which are' END || ' not in this document.'
          ELSE 'Inherits the rules of ' || i.parent || ', but no rule comes from there.' END FROM inherits i JOIN n USING (doc_id, policy_ix) LEFT JOIN gone USING (doc_id, policy_ix))
      SELECT doc_id, policy_ix, row_number() OVER (PARTITION BY doc_id, policy_ix ORDER BY k) - 1 AS ix, note FROM every WHERE note IS NOT NULL""",
    "p5_party_functions": f"""{ctes("lines")}, v AS ({VERBS.format(lines="lines")}),
      t AS (SELECT *, l_partkey % 5 AS f, 'p' || l_partkey || CASE WHEN l_partkey % 5 = 3 AND l_partkey % 3 = 0 AND l_partkey % 4 = 0 THEN ', x and y' WHEN l_partkey % 3 = 0 THEN ' and x' WHEN l_partkey % 5 = 3 AND l_partkey % 4 = 0 THEN ' and y' ELSE '' END AS names FROM v),
      w AS (SELECT *, verb <> 'use' AS spoken, CASE WHEN l_partkey % 4 = 0 AND f <> 3 THEN 'contracted party: y' END AS other,
        CASE f WHEN 0 THEN 'attributed party' WHEN 1 THEN 'compensated party' WHEN 2 THEN 'informed party' WHEN 3 THEN 'contracted party' ELSE 'tracking party' END || ': ' || names AS mine FROM t),
      a AS (SELECT *, CASE WHEN spoken THEN coalesce(' (' || other || ')', '') WHEN f IN (0, 1) THEN ' (' || mine || coalesce('; ' || other, '') || ')' ELSE ' (' || coalesce(other || '; ', '') || mine || ')' END AS aside FROM w)
      SELECT doc_id, policy_ix, rule_ix, verb, CASE WHEN spoken AND f IN (1, 2) AND NOT (l_partkey % 10 = 1 AND about <> '') THEN verb || ' ' || names ELSE verb END AS does,
        CASE WHEN NOT spoken THEN about WHEN f = 0 THEN CASE WHEN about = '' THEN ' the asset' ELSE about END || ' to ' || names WHEN f = 4 THEN about || ' by ' || names WHEN about = '' THEN ''
          WHEN l_partkey % 10 = 1 THEN ', for' || about || ', ' || names ELSE CASE f WHEN 1 THEN ' for' ELSE ' about' END || about END || aside AS "on" FROM a""",
    "p6_rule_sentences": f"""{PARTS} SELECT doc_id, policy_ix, path, CASE list WHEN 'permission' THEN coalesce(assignee, 'Anyone') || ' may ' WHEN 'prohibition' THEN coalesce(assignee || ' must not ', 'No one may ')
      ELSE coalesce(assignee, 'The assignee') || ' must ' END || coalesce(CASE action WHEN 'odrl:distribute' THEN 'distribute' WHEN 'ex:train' THEN 'train' WHEN 'ex:distil' THEN 'distil' WHEN 'foo:bar' THEN 'bar' ELSE action END,
      'perform an unspecified action on') || coalesce(' ' || target, CASE WHEN list = 'obligation' THEN '' ELSE ' an unspecified asset' END)
      || coalesce(', as ' || CASE list WHEN 'permission' THEN 'permitted' WHEN 'prohibition' THEN 'prohibited' ELSE 'required' END || ' by the assigner ' || assigner, '') || '.' AS sentence FROM parts""",
    "p7_constraint_text": f"{TEXTS} SELECT doc_id, policy_ix, path, text FROM texts",
    "p8_follow_up_labels": f"""{M} SELECT DISTINCT list, follow, CASE follow WHEN 'duty' THEN CASE list WHEN 'permission' THEN 'Duties to fulfil before this permission can be exercised' ELSE 'Duties attached to this rule' END
      WHEN 'remedy' THEN CASE list WHEN 'prohibition' THEN 'Remedies if this prohibition is breached' ELSE 'Remedies attached to this rule' END
      ELSE CASE list WHEN 'obligation' THEN 'Consequences if this duty is not fulfilled' ELSE 'Consequences attached to this rule' END END AS label FROM rules, (VALUES ('duty'), ('remedy'), ('consequence')) v(follow)""",
    "g13_condition_lines": f"""{TEXTS} SELECT doc_id, policy_ix, regexp_replace(path, '\\.child.*$', '') AS path, CASE logical_op WHEN 'and' THEN 'all of the following hold: ' WHEN 'or' THEN 'at least one of the following holds: ' ELSE '' END
      || string_agg(text, '; ' ORDER BY con_ix) AS line FROM texts GROUP BY doc_id, policy_ix, regexp_replace(path, '\\.child.*$', ''), logical_op""",
    "e5_glossary": f"""{M}, f AS (SELECT doc_id, policy_ix, iri, min([{order_sql('path')}, [[list_position({list(paths.SLOTS)}, slot), 0]]]) AS ord FROM expanded WHERE iri IN (SELECT iri FROM terms) GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, policy_ix ORDER BY ord, iri) - 1 AS ix FROM f) SELECT doc_id, policy_ix, ix, iri FROM r WHERE ix < 30""",
    "e6_mentions": f"""{M}, u AS (SELECT doc_id, policy_ix, rule_ix AS ord, unnest([assigner, assignee, target]) AS written FROM rules), f AS (SELECT doc_id, policy_ix, written, min(ord) AS ord FROM u WHERE written IS NOT NULL GROUP BY ALL)
      SELECT doc_id, policy_ix, row_number() OVER (PARTITION BY doc_id, policy_ix ORDER BY ord, written) - 1 AS ix, written FROM f""",
    "names_of_terms": f"""{M}, t AS (SELECT written AS term FROM expanded UNION SELECT iri FROM expanded)
      SELECT term, {local("term")} AS local, regexp_extract(term, '[^/#:]*$') AS short, {human("(" + local("term") + ")")} AS human, regexp_extract(term, '^.*[#/]') AS ns, rtrim(term, '#/') AS trimmed,
        NOT regexp_matches(term, '[\\s<>"{{}}|\\\\^`]') AS ok, {_ACTION.format("term")} AS action, {_OPERANDS.format("term")} AS operand FROM t""",
    "h8_duration_words": f"""WITH v AS (SELECT DISTINCT {_DURATION_VALUE} AS value FROM lineitem),
      p AS (SELECT value, regexp_full_match(value, '-?P([0-9]+Y)?([0-9]+M)?([0-9]+W)?([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+S)?)?') AND NOT regexp_matches(value, '(P|T)$') AS ok,
        ltrim(regexp_extract(split_part(value, 'T', 1), '([0-9]+)Y', 1), '0') AS y, ltrim(regexp_extract(split_part(value, 'T', 1), '([0-9]+)M', 1), '0') AS m,
        ltrim(regexp_extract(split_part(value, 'T', 1), '([0-9]+)D', 1), '0') AS d, ltrim(regexp_extract(split_part(value, 'T', 2), '([0-9]+)H', 1), '0') AS h FROM v),
      l AS (SELECT value, ok, list_filter([CASE WHEN y <> '' THEN y || ' year' || CASE y WHEN '1' THEN '' ELSE 's' END END, CASE WHEN m <> '' THEN m || ' month' || CASE m WHEN '1' THEN '' ELSE 's' END END,
        CASE WHEN d <> '' THEN d || ' day' || CASE d WHEN '1' THEN '' ELSE 's' END END, CASE WHEN h <> '' THEN h || ' hour' || CASE h WHEN '1' THEN '' ELSE 's' END END], lambda x: x IS NOT NULL) AS parts FROM p)
      SELECT value, ok AS lexical, CASE WHEN ok THEN CASE WHEN value LIKE '-%' THEN 'minus ' ELSE '' END || CASE len(parts) WHEN 1 THEN parts[1] ELSE array_to_string(parts[:-2], ', ') || ' and ' || parts[-1] END END AS words FROM l""",
    "h9_value_shapes": f"""{M} SELECT DISTINCT raw, datatype, CASE WHEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND (datatype IS NULL OR datatype = 'xsd:date') THEN 'DateOnly' ELSE 'Other' END AS shape,
      CASE datatype WHEN 'xsd:integer' THEN regexp_full_match(raw, '[+-]?[0-9]+') WHEN 'xsd:date' THEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') WHEN 'xsd:boolean' THEN raw IN ('true', 'false', '1', '0') END AS valid,
      {_QUOTED.format("raw")} AS quoted FROM constraints WHERE right_kind = 'literal'""",
    "h12_page_urls": "SELECT page_id, url AS urls FROM pages",
    "h27_language_ranges": "SELECT DISTINCT lang, concat(lang, '-XX-x-', lang, ' ', lang, '-XX-x ', lang, '-XX ', lang) AS ranges FROM documents",
    "a4_html_blocks": """WITH b AS (SELECT page_id, html, string_split_regex(html, '<p[ >]') AS parts FROM pages),
      e AS (SELECT page_id, unnest(parts[2:]) AS piece, generate_subscripts(parts[2:], 1) AS ix, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM b)
      SELECT page_id, CAST(ix AS INT) AS ix, trim(regexp_replace(regexp_replace(regexp_extract(piece, '(?s)^(.*?)(?:</p>|$)', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text,
        CASE WHEN piece IS NULL THEN '' ELSE trim(regexp_replace(heading, '\\s+', ' ', 'g')) END AS heading FROM e""",
    "d1_features": f"{KEYS} SELECT feature, count(*) AS n FROM feats GROUP BY feature",
    "d2_coverage": f"{KEYS} SELECT * FROM cov",
    "d3_source_totals": f"""{ENTRIES} SELECT source, count(*) AS n, count(*) FILTER (NOT incomplete AND NOT warned) AS complete, count(*) FILTER (NOT incomplete AND warned) AS with_warnings,
      count(*) FILTER (incomplete) AS incomplete FROM entries GROUP BY source""",
    "d4_coverage_gaps": f"""{KEYS}, z AS (SELECT feature, source, CASE WHEN source = 'source-0' AND feature < 'c' THEN 0 ELSE n END AS n FROM cov)
      SELECT feature, string_agg(source, ', ' ORDER BY source) FILTER (source <> 'source-0' AND n > 0) AS used_by FROM z GROUP BY feature
      HAVING coalesce(max(n) FILTER (source = 'source-0'), 0) = 0 AND coalesce(max(n) FILTER (source <> 'source-0'), 0) > 0""",
    "b11_reading_status": f"{ENTRIES} SELECT source, CASE WHEN incomplete THEN 'incomplete' WHEN warned THEN 'with warnings' ELSE 'complete' END AS status, count(*) AS n FROM entries GROUP BY ALL",
    "c19_live_links": "SELECT DISTINCT url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 <> 0)",
}
ORACLES["e5_glossary_full"] = ORACLES["e5_glossary"]
