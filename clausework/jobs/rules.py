"""Queries for inheritance, the structural and hint rules, verdicts and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.corpus import Corpus, ctes
from clausework.functions.names import local_name
from clausework.functions.paths import SLOTS, WALK
from clausework.jobs.terms import BASE, USES
from clausework.jobs.terms import ORACLES as TERM_ORACLES
from clausework.model import RULES, Options
from clausework.operators import hints, inherit, lists, report, resolve, structure
from clausework.sources.shared import cut

KEY = ["doc_id", "policy_ix"]


def _links(c: Corpus) -> DataFrame:
    return inherit.inherit_links(c.policies, c.inherits, c.prefixes)


def _classes(c: Corpus) -> DataFrame:
    kinds = resolve.expand_terms(c.policies.select(*KEY, F.col("kind").alias("written")), c.prefixes, c.profiles)
    return structure.odrl_class(kinds.select(*KEY, F.col("iri").alias("kind_iri")), c.links)


def _constraints(c: Corpus) -> DataFrame:
    """Constraints with left_iri, operator_name, value_any, value_iri and unit_iri."""
    out = c.constraints
    for col, name in (("lft", "left_iri"), ("raw", "value_any"), ("unit", "unit_iri")):
        out = resolve.expand_terms(out, c.prefixes, c.profiles, col).withColumnRenamed("iri", name).drop("expanded_by")
    return out.withColumn("operator_name", local_name(F.col("operator"))).withColumn("value_iri", F.when(F.col("right_kind") == "iri", F.col("value_any")))


def _structural(c: Corpus, options: Options | None = None) -> DataFrame:
    """Findings of the structural rules; with ``options``, groups of rules that are all off are not judged."""
    links = cut(_links(c), "links")
    on = {rule for rule, _, _, level, _ in (options.table() if options else ()) if level != "off"}
    judged = lambda *rules: options is None or not on.isdisjoint(rules)
    parts = [structure.constraint_findings(c.constraints)]
    if judged(*structure.POLICY_RULES):
        parts.append(structure.policy_findings(c.policies, c.rules, c.inherits, inherit.on_cycle(links), links))
    else:
        parts.append(structure.unchecked_parents(links))
    if judged(*structure.RULE_RULES):
        parts.append(structure.rule_findings(c.rules, inherit.inherited_mask(c.policies, links), _classes(c)))
    return reduce(DataFrame.unionByName, parts)


def _hints(c: Corpus) -> DataFrame:
    gaps = resolve.covered_profiles(c.policies, c.profiles).where("not covered")
    return hints.hint_findings(_constraints(c), c.hints, c.hint_operators, c.hint_values, c.hint_units, gaps)


def _parts(c: Corpus, options: Options = Options(), more: Sequence[DataFrame] = ()) -> list[DataFrame]:  # noqa: B008
    """The findings, one table for each kind of rule."""
    no_term = F.lit(None).cast("string").alias("written")
    open_ = F.lit(False).alias("closed")
    gaps = resolve.covered_profiles(c.policies, c.profiles).where("not covered").select(
        *KEY, F.concat(F.lit("policy["), F.col("policy_ix").cast("string"), F.lit("]")).alias("path"), F.lit("profile.not-loaded").alias("rule"), F.col("profile").alias("written"), open_
    )
    terms = resolve.term_findings(resolve.term_uses(c.policies, c.rules, c.constraints), c.policies, c.prefixes, c.profiles, c.terms, c.odrl_terms)
    every = [
        gaps,
        terms.select(*KEY, "path", "rule", "written", open_),
        _structural(c, options).select(*KEY, "path", "rule", no_term, open_),
        _hints(c).select(*KEY, "path", "rule", no_term, "closed"),
        *more,
    ]
    levels = report.rule_levels(c.spark, options)
    return [report.with_severity(found, levels) for found in every]


def _each(parts: Sequence[DataFrame], summary: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The summaries of the parts, each written before the next one starts.

    The driver holds the plan and the broadcasts of one kind of rule at a time, not of all in one job.
    """
    return reduce(DataFrame.unionByName, [cut(summary(found), "part") for found in parts])


def _verdicts(c: Corpus, parts: Sequence[DataFrame]) -> DataFrame:
    return report.judged(_each(parts, lambda found: report.counted(found, KEY)), c.policies, KEY)


def _reports(c: Corpus, options: Options = Options()) -> DataFrame:  # noqa: B008
    """The whole report of each document: findings with their slot, what is expected there and what mends them."""
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    open_ = F.lit(False).alias("closed")
    policy = F.concat(F.lit("policy["), F.col("policy_ix").cast("string"), F.lit("]")).alias("path")
    cols = [*KEY, "path", "slot", "rule", "written", "iri", "left_iri", "closed"]
    gaps = resolve.covered_profiles(c.policies, c.profiles).where("not covered").select(*KEY, policy, F.lit("profile.not-loaded").alias("rule"), F.col("profile").alias("written"), F.col("profile").alias("iri"), *none("slot", "left_iri"), open_)
    # Findings of terms and hints are told and mended: written once, not found twice.
    terms = cut(resolve.term_findings(resolve.term_uses(c.policies, c.rules, c.constraints), c.policies, c.prefixes, c.profiles, c.terms, c.odrl_terms, with_iri=True), "terms")
    slot = F.when(F.col("rule") == "prose.operator-not-allowed", "operator").when(F.col("rule") == "prose.unit-not-allowed", "unit").when(F.col("rule") != "input.unchecked", "value")
    hinted = cut(_hints(c).withColumns({"slot": slot, "iri": F.lit(None).cast("string")}), "hinted")
    parts = [gaps, terms.select("*", *none("left_iri"), open_), _structural(c).select(*KEY, "path", "rule", *none("slot", "written", "iri", "left_iri"), open_), hinted]
    found = reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])
    found = cut(report.with_severity(found, report.rule_levels(c.spark, options)), "findings")
    expanded = resolve.expand_terms(resolve.term_uses(c.policies, c.rules, c.constraints), c.prefixes, c.profiles)
    fixes = lists.fixes(terms, expanded, c.terms, c.profiles, hinted, c.constraints, _duplicates(c), structure.heuristic_findings(c.constraints))
    expected = hints.expected_of(c.hints, c.hint_operators, c.hint_values, c.hint_units)
    return report.report_json(found, report.verdicts(found, c.policies, ["doc_id"]), options, c.profiles, expected, fixes)


def _duplicates(c: Corpus) -> DataFrame:
    """The lines of an order seen as actions of one rule."""
    actions = c.rules.where("action is not null").select(
        "doc_id", F.concat(F.lit("policy["), F.col("policy_ix").cast("string"), F.lit("]")).alias("owner"), F.col("rule_ix").alias("ix"), F.col("action").alias("iri"), F.col("target").alias("refinements")
    )
    return structure.duplicate_actions(actions)


def _nesting(c: Corpus) -> DataFrame:
    """Rules hung below each other: a line's list by its number, its parent the line before."""
    lists = F.element_at(F.array(*[F.lit(x) for x in ("duty", "consequence", "remedy", "consequence")]), (F.col("rule_ix") % 4 + 1).cast("int"))
    at = lambda ix: F.concat(F.lit("policy["), F.col("policy_ix").cast("string"), F.lit("].rule["), ix.cast("string"), F.lit("]"))
    return structure.nesting_findings(
        c.rules.select("doc_id", "policy_ix", at(F.col("rule_ix")).alias("path"), at(F.col("rule_ix") - 1).alias("parent_path"), lists.alias("list"))
    )


# Heuristics are off unless they are asked for.
ALL_ON = Options(levels={r: "warning" for r in ("heuristic.ordered-on-unordered", "heuristic.single-child-group", "heuristic.duplicate-action")})


def _catalogue(c: Corpus) -> list[DataFrame]:
    """Findings of all rules on policies, by kind: nesting and the heuristics too."""
    nothing, open_ = F.lit(None).cast("string").alias("written"), F.lit(False).alias("closed")
    policy = F.regexp_extract("owner", r"[0-9]+", 0).cast("int").alias("policy_ix")
    twice = _duplicates(c).select("doc_id", policy, F.col("owner").alias("path"), F.lit("heuristic.duplicate-action").alias("rule"), F.col("iri").alias("written"), open_)
    more = [found.select(*KEY, "path", "rule", nothing, open_) for found in (_nesting(c), structure.heuristic_findings(c.constraints))]
    return _parts(c, ALL_ON, [*more, twice])


def _tiers(c: Corpus, options: Options) -> DataFrame:
    """The tiers in force, with the number of findings of each."""
    found = _each(_parts(c, options), lambda part: part.groupBy("tier").agg(F.count("*").alias("n"))).groupBy("tier").agg(F.sum("n").alias("n"))
    return report.tiers_in_force(report.rule_levels(c.spark, options)).join(found, "tier", "left").select("tier", "ix", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    "policy_verdicts": lambda c: _verdicts(c, _parts(c)),
    "r1_catalogue_verdicts": lambda c: _verdicts(c, _catalogue(c)),
    "structural_rules": _structural,
    "c7_inherit_links": _links,
    "g4_lineages": lambda c: inherit.lineages(_links(c)),
    "g5_on_cycle": lambda c: inherit.on_cycle(_links(c)),
    "g6_inherited_mask": lambda c: inherit.inherited_mask(c.policies, _links(c)),
    "g10_odrl_class": _classes,
    "d15_lent_values": lambda c: inherit.lent_values(inherit.lineages(_links(c)), c.policies),
    "u2_written_profiles": lambda c: inherit.written_profiles(c.policies, inherit.lineages(_links(c))),
    "hint_rules": lambda c: _hints(c).drop("left_iri", "written"),
    "c14_disallowed_values": lambda c: hints.disallowed_values(
        _constraints(c).where("n_values > 0 or right_kind = 'iri'").select("doc_id", "policy_ix", "path", "left_iri", F.coalesce("value_iri", F.lit("")).alias("iri"), "raw"), c.hint_values
    ).select("doc_id", "policy_ix", "path", "left_iri", "raw"),
    "c15_out_of_bounds": lambda c: hints.with_hints(_constraints(c), c.hints)
    .where((F.col("right_kind") == "literal") & hints.outside_bounds(F.col("raw"), F.col("h_lo"), F.col("h_hi")))
    .select("doc_id", "policy_ix", "path", "raw"),
    "c16_pattern_mismatch": lambda c: hints.with_hints(_constraints(c), c.hints)
    .where((F.col("right_kind") == "literal") & hints.pattern_mismatch(F.col("raw"), F.col("h_pattern")))
    .select("doc_id", "policy_ix", "path", "raw"),
    "d14_expected_values": lambda c: hints.expected_values(c.hint_values).select("left_iri", F.array_join("values", ",").alias("values"), "total"),
    "d14_expected_values_full": lambda c: hints.expected_values(c.hint_values).select("left_iri", F.array_join("values", ",").alias("values"), "total"),
    "heuristic_rules": lambda c: structure.heuristic_findings(c.constraints),
    "e8_duplicate_actions": _duplicates,
    "consequence_nesting": _nesting,
    "d7_distinct_gaps": lambda c: report.gaps_in_order(_each(_parts(c), report.gaps_at)),
    "d8_tiers_in_force": lambda c: _tiers(c, Options(structural=False)),
    "d9_batch_exit": lambda c: report.batch_exit(_verdicts(c, _parts(c))),
    "d13_cap_named": lambda c: report.cap_named(c.policies.where("profile is not null").select("doc_id", "policy_ix", "profile"), ["doc_id", "profile"], ["policy_ix"]).select(
        "doc_id", "policy_ix", "profile", "n_more"
    ),
    "severity_counts": lambda c: _each(_parts(c), lambda part: part.groupBy("rule", "severity", "gap").agg(F.count("*").alias("n"))).groupBy("rule", "severity", "gap").agg(F.sum("n").alias("n")),
    "r2_report_json": _reports,
    "r7_new_findings": lambda c: report.new_findings(_structural(c), _structural(c).where("doc_id % 2 = 0"), ["doc_id", "policy_ix", "path", "rule"]),
    "h22_fingerprint": lambda c: _structural(c).select(*KEY, "path", "rule", report.fingerprint(F.col("rule"), F.col("path"), F.lit("")).alias("fingerprint")),
}

NUMBER = lambda x: f"TRY_CAST(trim({x}) AS DOUBLE)"
MOMENT = lambda x: f"regexp_matches(trim({x}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"


def _less(a: str, b: str) -> str:
    n = f"least(length(trim({a})), length(trim({b})))"
    return f"coalesce(CASE WHEN {NUMBER(a)} IS NOT NULL THEN {NUMBER(a)} < {NUMBER(b)} WHEN {MOMENT(a)} AND {MOMENT(b)} THEN substr(trim({a}), 1, {n}) < substr(trim({b}), 1, {n}) END, false)"


def order_sql(path: str) -> str:
    """A path's place as a list of (rank, number) for each member: numbers compare as numbers, an ancestor comes before what it holds."""
    rank = f"coalesce(list_position({list(WALK)}, split_part(s, '[', 1)), 99)"
    return f"list_transform(string_split({path}, '.'), lambda s: [{rank}, coalesce(TRY_CAST(regexp_extract(s, '\\[([0-9]+)\\]', 1) AS INT), -1)])"


OUTSIDE = f"({_less('raw', 'lo')} OR {_less('hi', 'raw')})"


def _merged() -> str:
    """All tables and the common parts, each once."""
    return (
        ctes("policies", "rules", "constraints", "prefixes", "profiles", "terms", "odrl_terms", "inherits", "links", "hints", "hint_operators", "hint_values", "hint_units")
        + f""",
{USES},
uids AS (SELECT doc_id, uid, min(policy_ix) AS ix FROM policies WHERE uid IS NOT NULL GROUP BY ALL),
links_in AS (SELECT i.doc_id, i.policy_ix, i.parent, u.ix AS parent_ix FROM inherits i LEFT JOIN uids u ON u.doc_id = i.doc_id AND u.uid = regexp_replace(i.parent, '^pol:', CASE WHEN i.doc_id % 2 = 0 THEN 'urn:policy:' ELSE 'pol:' END)),
walk AS (
  SELECT doc_id, policy_ix, parent_ix AS ancestor_ix, 0 AS ix, [policy_ix, parent_ix] AS seen FROM links_in WHERE parent_ix IS NOT NULL AND parent_ix <> policy_ix
  UNION ALL SELECT w.doc_id, w.policy_ix, l.parent_ix, w.ix + 1, list_append(w.seen, l.parent_ix) FROM walk w JOIN links_in l ON l.doc_id = w.doc_id AND l.policy_ix = w.ancestor_ix
  WHERE l.parent_ix IS NOT NULL AND NOT list_contains(w.seen, l.parent_ix)),
circle AS (SELECT DISTINCT l.doc_id, l.policy_ix FROM links_in l WHERE l.parent_ix = l.policy_ix
  UNION SELECT DISTINCT w.doc_id, w.policy_ix FROM walk w JOIN links_in l ON l.doc_id = w.doc_id AND l.policy_ix = w.ancestor_ix AND l.parent_ix = w.policy_ix),
own AS (SELECT p.doc_id, p.policy_ix, (assigner IS NOT NULL)::INT + 2 * (assignee IS NOT NULL)::INT + 4 * (target IS NOT NULL)::INT + 8 * (action IS NOT NULL)::INT
    + 16 * (l.doc_id IS NOT NULL)::INT AS mask
  FROM policies p LEFT JOIN links_in l ON l.doc_id = p.doc_id AND l.policy_ix = p.policy_ix AND l.parent_ix IS NULL),
masks AS (SELECT doc_id, policy_ix, bit_or(mask) AS mask FROM (SELECT * FROM own UNION ALL
    SELECT w.doc_id, w.policy_ix, o.mask FROM walk w JOIN own o ON o.doc_id = w.doc_id AND o.policy_ix = w.ancestor_ix) GROUP BY ALL),
classes AS (SELECT p.doc_id, p.policy_ix, CASE kind WHEN 'Offer' THEN 'Offer' WHEN 'Agreement' THEN 'Agreement' WHEN 'ex:ResearchAgreement' THEN 'Agreement' ELSE 'Other' END AS class FROM policies p),
structural AS (
  SELECT doc_id, policy_ix, concat('policy[', policy_ix, ']') AS path, 'odrl.policy-uid' AS rule FROM policies WHERE uid IS NULL
  UNION ALL SELECT doc_id, policy_ix, concat('policy[', policy_ix, ']'), 'odrl.no-rule' FROM policies p WHERE parent_ix IS NULL
    AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.doc_id = p.doc_id AND r.policy_ix = p.policy_ix)
  UNION ALL SELECT doc_id, policy_ix, concat('policy[', policy_ix, ']'), 'odrl.inheritance-cycle' FROM circle
  UNION ALL SELECT doc_id, policy_ix, concat('policy[', policy_ix, ']'), 'input.unchecked' FROM links_in WHERE parent_ix IS NULL
  UNION ALL SELECT doc_id, policy_ix, path, 'odrl.offer-assigner' FROM rules JOIN masks USING (doc_id, policy_ix) JOIN classes USING (doc_id, policy_ix)
    WHERE class = 'Offer' AND assigner IS NULL AND mask & 17 = 0
  UNION ALL SELECT doc_id, policy_ix, path, 'odrl.agreement-parties' FROM rules JOIN masks USING (doc_id, policy_ix) JOIN classes USING (doc_id, policy_ix)
    WHERE class = 'Agreement' AND ((assigner IS NULL AND mask & 17 = 0) OR (assignee IS NULL AND mask & 18 = 0))
  UNION ALL SELECT doc_id, policy_ix, path, 'odrl.rule-target' FROM rules JOIN masks USING (doc_id, policy_ix) WHERE list <> 'obligation' AND target IS NULL AND mask & 20 = 0
  UNION ALL SELECT doc_id, policy_ix, path, 'odrl.rule-action' FROM rules JOIN masks USING (doc_id, policy_ix) WHERE action IS NULL AND mask & 24 = 0
  UNION ALL SELECT doc_id, policy_ix, path, 'odrl.constraint-shape' FROM constraints WHERE lft IS NULL OR right_kind = 'missing'
  UNION ALL SELECT doc_id, policy_ix, path, 'odrl.constraint-incomplete' FROM constraints WHERE NOT (lft IS NULL OR right_kind = 'missing') AND right_kind = 'literal' AND trim(raw) = ''
  UNION ALL SELECT doc_id, policy_ix, path, 'odrl.set-operator-cardinality' FROM constraints WHERE n_values > 1 AND operator IN ('eq', 'neq', 'gt', 'odrl:lteq')),
hc AS (SELECT c.*, CASE WHEN lft IN ('dateTime', 'count') THEN 'http://www.w3.org/ns/odrl/2/' || lft WHEN lft = 'odrl:percentage' THEN 'http://www.w3.org/ns/odrl/2/percentage'
    WHEN lft LIKE 'ex:%' THEN 'https://example.org/a#' || substr(lft, 4) END AS left_iri,
    CASE WHEN right_kind = 'iri' THEN 'https://example.org/a#' || substr(raw, 4) END AS value_iri,
    CASE WHEN unit IS NOT NULL THEN 'https://example.org/a#' || substr(unit, 4) END AS unit_iri, replace(operator, 'odrl:', '') AS op FROM constraints c),
hw AS (SELECT hc.*, h.datatype AS want, lo, hi, pattern, coalesce(closed, false) AS shut FROM hc LEFT JOIN hints h USING (left_iri)),
valid AS (SELECT *, CASE want WHEN 'xsd:integer' THEN regexp_full_match(raw, '[+-]?[0-9]+') WHEN 'xsd:date' THEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') END AS want_ok,
    CASE datatype WHEN 'xsd:integer' THEN regexp_full_match(raw, '[+-]?[0-9]+') WHEN 'xsd:date' THEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
      WHEN 'xsd:boolean' THEN raw IN ('true', 'false', '1', '0') END AS own_ok FROM hw),
hinted AS (
  SELECT doc_id, policy_ix, path, 'prose.operator-not-allowed' AS rule, shut AS closed, operator AS written FROM valid WHERE left_iri IN (SELECT left_iri FROM hint_operators)
    AND NOT EXISTS (SELECT 1 FROM hint_operators o WHERE o.left_iri = valid.left_iri AND o.op = replace(split_part(valid.op, ':', -1), 'x', 'x'))
  UNION ALL SELECT doc_id, policy_ix, path, 'prose.datatype-lexical', shut, NULL FROM valid WHERE right_kind = 'literal' AND want_ok = false
  UNION ALL SELECT doc_id, policy_ix, path, 'prose.value-not-allowed', shut, raw FROM valid v WHERE right_kind = 'iri' AND left_iri IN (SELECT left_iri FROM hint_values)
    AND NOT EXISTS (SELECT 1 FROM hint_values h WHERE h.left_iri = v.left_iri AND h.value = value_iri AND NOT h.literal)
    AND NOT (shut AND EXISTS (SELECT 1 FROM policies p WHERE p.doc_id = v.doc_id AND p.policy_ix = v.policy_ix AND rtrim(p.profile, '/#') NOT IN (SELECT rtrim(iri, '/#') FROM profiles)))
  UNION ALL SELECT doc_id, policy_ix, path, CASE WHEN EXISTS (SELECT 1 FROM hint_values h WHERE h.left_iri = v.left_iri AND NOT h.literal
      AND h.value = CASE WHEN raw LIKE '%:%' THEN raw ELSE 'http://www.w3.org/ns/odrl/2/' || raw END) THEN 'prose.iri-expected' ELSE 'prose.value-not-allowed' END, true, raw
    FROM valid v WHERE right_kind = 'literal' AND shut AND left_iri IN (SELECT left_iri FROM hint_values)
    AND NOT EXISTS (SELECT 1 FROM hint_values h WHERE h.left_iri = v.left_iri AND h.literal AND (h.value = raw OR TRY_CAST(trim(h.value) AS DOUBLE) = TRY_CAST(trim(raw) AS DOUBLE)))
  UNION ALL SELECT doc_id, policy_ix, path, 'prose.value-not-allowed', shut, NULL FROM valid WHERE right_kind = 'literal'
    AND ((pattern IS NOT NULL AND NOT regexp_matches(raw, pattern)) OR {OUTSIDE})
  UNION ALL SELECT doc_id, policy_ix, path, 'prose.unit-not-allowed', shut, unit FROM valid WHERE unit_iri IS NOT NULL AND left_iri IN (SELECT left_iri FROM hint_units) AND unit_iri NOT IN (SELECT unit FROM hint_units)
  UNION ALL SELECT doc_id, policy_ix, path, 'prose.datatype-conflict', shut, NULL FROM valid WHERE right_kind = 'literal' AND datatype <> want
  UNION ALL SELECT doc_id, policy_ix, path, 'prose.ill-typed-literal', false, NULL FROM valid WHERE right_kind = 'literal' AND own_ok = false AND (want IS NULL OR want <> datatype))"""
    )


M = _merged()


def _all_findings(options: Options = Options(), more: str = "") -> str:  # noqa: B008
    judged = TERM_ORACLES["profile_rules"][len(BASE) :]
    tables = judged[: judged.rindex("SELECT doc_id, policy_ix, path, slot, rule, written FROM judged")]
    levels = ", ".join(
        f"('{r}', {str(closed).lower()}, '{level}', {str(gap).lower()})" for r, _, closed, level, gap in options.table()
    )
    return f"""{M}{tables.rstrip()},
levels AS (SELECT * FROM (VALUES {levels}) AS t(rule, closed, severity, gap)),
findings AS (SELECT f.*, l.severity, l.gap FROM (
    SELECT doc_id, policy_ix, path, rule, written, false AS closed FROM judged WHERE rule IS NOT NULL
    UNION ALL SELECT doc_id, policy_ix, path, 'profile.deprecated-term', written, false FROM wide WHERE term_deprecated
    UNION ALL SELECT doc_id, policy_ix, concat('policy[', policy_ix, ']'), 'profile.not-loaded', profile, false FROM policies JOIN gaps USING (doc_id, policy_ix)
    UNION ALL SELECT doc_id, policy_ix, path, rule, NULL, false FROM structural
    UNION ALL SELECT doc_id, policy_ix, path, rule, NULL, closed FROM hinted{more}) f JOIN levels l USING (rule, closed) WHERE severity <> 'off'),
judgement AS (SELECT doc_id, policy_ix, CASE WHEN coalesce(bool_or(severity = 'error' AND NOT gap), false) THEN 'violations' WHEN coalesce(bool_or(gap), false) THEN 'incomplete' ELSE 'conforms' END AS verdict,
    count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info
  FROM policies LEFT JOIN findings USING (doc_id, policy_ix) GROUP BY doc_id, policy_ix)"""


# The SQL of single rules; a backslash stands for itself.
HEURISTIC = r"""SELECT doc_id, policy_ix, path, 'heuristic.ordered-on-unordered' AS rule FROM hc WHERE op IN ('gt', 'gteq', 'lt', 'lteq') AND right_kind = 'iri'
      UNION ALL SELECT doc_id, policy_ix, regexp_replace(path, '\.child\[[0-9]+\]$', ''), 'heuristic.single-child-group' FROM constraints WHERE logical_op IS NOT NULL GROUP BY ALL HAVING count(*) = 1"""
DUPLICATE = """SELECT r.doc_id, concat('policy[', r.policy_ix, ']') AS owner, r.rule_ix AS ix, r.action AS iri, bool_or(r.target IS NOT DISTINCT FROM b.target) AS removable
      FROM rules r JOIN rules b ON b.doc_id = r.doc_id AND b.policy_ix = r.policy_ix AND b.action = r.action AND b.rule_ix < r.rule_ix GROUP BY ALL"""
NESTING = """SELECT DISTINCT c.doc_id, c.policy_ix, concat('policy[', a.policy_ix, '].rule[', a.rule_ix, ']') AS path, 'odrl.consequence-nesting' AS rule
      FROM (SELECT doc_id, policy_ix, rule_ix, ['duty', 'consequence', 'remedy', 'consequence'][rule_ix % 4 + 1] AS list FROM rules) c
  JOIN (SELECT doc_id, policy_ix, rule_ix, ['duty', 'consequence', 'remedy', 'consequence'][rule_ix % 4 + 1] AS list FROM rules) a ON a.doc_id = c.doc_id AND a.policy_ix = c.policy_ix AND a.rule_ix = c.rule_ix - 1 WHERE c.list = 'consequence' AND a.list IN ('consequence', 'remedy')"""
MORE = f"""
    UNION ALL SELECT doc_id, policy_ix, path, rule, NULL, false FROM ({HEURISTIC})
    UNION ALL SELECT doc_id, policy_ix, path, rule, NULL, false FROM ({NESTING})
    UNION ALL SELECT doc_id, CAST(regexp_extract(owner, '[0-9]+') AS INT), owner, 'heuristic.duplicate-action', iri, false FROM ({DUPLICATE})"""
FOUND = _all_findings()
ORACLES = {
    "policy_verdicts": f"{FOUND} SELECT * FROM judgement",
    "r1_catalogue_verdicts": f"{_all_findings(ALL_ON, MORE)} SELECT * FROM judgement",
    "structural_rules": f"{M} SELECT * FROM structural",
    "c7_inherit_links": f"{M} SELECT * FROM links_in",
    "g4_lineages": f"{M} SELECT doc_id, policy_ix, ancestor_ix, ix FROM walk",
    "g5_on_cycle": f"{M} SELECT * FROM circle",
    "g6_inherited_mask": f"{M} SELECT * FROM masks",
    "g10_odrl_class": f"{M} SELECT * FROM classes",
    "d15_lent_values": f"""{M}, stated AS (SELECT w.doc_id, w.policy_ix, key, value FROM walk w JOIN (UNPIVOT (SELECT doc_id, policy_ix, assigner, assignee, target, action, conflict FROM policies)
      ON assigner, assignee, target, action, conflict INTO NAME key VALUE value) p ON p.doc_id = w.doc_id AND p.policy_ix = w.ancestor_ix)
      SELECT doc_id, policy_ix, key, min(value) AS value FROM stated GROUP BY ALL HAVING count(DISTINCT value) = 1""",
    "u2_written_profiles": f"""{M}, listed AS (SELECT doc_id, policy_ix, -1 AS pos, profile FROM policies UNION ALL SELECT w.doc_id, w.policy_ix, w.ix, p.profile FROM walk w
      JOIN policies p ON p.doc_id = w.doc_id AND p.policy_ix = w.ancestor_ix), firsts_p AS (SELECT doc_id, policy_ix, profile, min(pos) AS pos FROM listed WHERE profile IS NOT NULL GROUP BY ALL)
      SELECT doc_id, policy_ix, row_number() OVER (PARTITION BY doc_id, policy_ix ORDER BY pos) - 1 AS ix, profile FROM firsts_p""",
    "hint_rules": f"{M} SELECT doc_id, policy_ix, path, rule, closed FROM hinted",
    "c14_disallowed_values": f"{M} SELECT doc_id, policy_ix, path, left_iri, raw FROM hc WHERE left_iri IN (SELECT left_iri FROM hint_values) AND right_kind <> 'missing' "
    "AND NOT EXISTS (SELECT 1 FROM hint_values h WHERE h.left_iri = hc.left_iri AND (h.value = value_iri OR h.value = raw))",
    "c15_out_of_bounds": f"{M} SELECT doc_id, policy_ix, path, raw FROM hw WHERE right_kind = 'literal' AND {OUTSIDE}",
    "c16_pattern_mismatch": f"{M} SELECT doc_id, policy_ix, path, raw FROM hw WHERE right_kind = 'literal' AND pattern IS NOT NULL AND NOT regexp_matches(raw, pattern)",
    "d14_expected_values": f"{ctes('hint_values')} SELECT left_iri, string_agg(value, ',' ORDER BY ix) FILTER (ix < 8) AS values, CASE WHEN count(*) > 8 THEN count(*)::INT END AS total FROM hint_values GROUP BY left_iri",
    "heuristic_rules": f"{M} {HEURISTIC}",
    "e8_duplicate_actions": f"{M} {DUPLICATE}",
    "consequence_nesting": f"{M} {NESTING}",
    "d7_distinct_gaps": f"""{FOUND}, g AS (SELECT doc_id, rule, coalesce(written, path) AS detail, policy_ix, path,
        row_number() OVER (PARTITION BY doc_id, rule, coalesce(written, path) ORDER BY {order_sql("path")}) AS rn FROM findings WHERE gap)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {order_sql("path")}, rule, detail) - 1 AS ix, rule, detail FROM g WHERE rn = 1""",
    "d8_tiers_in_force": f"""{_all_findings(Options(structural=False))}, tiers AS (SELECT * FROM (VALUES ('profile', 0), ('odrl', 1), ('prose', 2), ('input', 3)) AS t(tier, ix))
      SELECT tier, ix, count(rule) AS n FROM tiers LEFT JOIN findings ON split_part(rule, '.', 1) = tier GROUP BY tier, ix""",
    "d9_batch_exit": f"{FOUND} SELECT CASE max(CASE verdict WHEN 'violations' THEN 2 WHEN 'incomplete' THEN 1 ELSE 0 END) WHEN 2 THEN 1 WHEN 1 THEN 3 ELSE 0 END AS exit_code FROM judgement",
    "d13_cap_named": f"""{ctes("policies")} SELECT doc_id, policy_ix, profile, greatest(n - 20, 0) AS n_more FROM (SELECT doc_id, policy_ix, profile,
      row_number() OVER (PARTITION BY doc_id, profile ORDER BY policy_ix) AS rn, count(*) OVER (PARTITION BY doc_id, profile) AS n FROM policies WHERE profile IS NOT NULL) WHERE rn <= 20""",
    "severity_counts": f"{FOUND} SELECT rule, severity, gap, count(*) AS n FROM findings GROUP BY ALL",
    "r7_new_findings": f"{M} SELECT DISTINCT * FROM structural WHERE doc_id % 2 <> 0 UNION ALL SELECT * FROM structural WHERE false",
}
FIXES = f"""tf AS (SELECT DISTINCT doc_id, path, slot, rule, written FROM judged WHERE rule IN ('profile.unbound-prefix', 'profile.not-declared')), met AS (SELECT DISTINCT tf.*, e.iri FROM tf JOIN expanded e USING (doc_id, path, slot, written)),
  fixes AS (SELECT doc_id, path, rule, slot, 'Write the full IRI' AS label, iri AS replacement, true AS safe FROM met WHERE rule = 'profile.unbound-prefix'
      UNION ALL SELECT doc_id, path, rule, slot, 'Declare the profile <' || p.iri || '>', p.iri, true FROM met JOIN firsts f ON f.iri = met.iri JOIN profiles p ON p.profile_id = f.profile_id WHERE rule = 'profile.not-declared'
      UNION ALL SELECT h.doc_id, h.path, h.rule, 'value', 'Write it as an IRI', raw, true FROM (SELECT DISTINCT doc_id, path, rule FROM hinted WHERE rule = 'prose.iri-expected') h JOIN constraints c ON c.doc_id = h.doc_id AND c.path = h.path
      UNION ALL SELECT doc_id, owner || '.action[' || ix || ']', 'heuristic.duplicate-action', 'action', 'Remove the duplicate', '', true FROM ({DUPLICATE}) WHERE removable
      UNION ALL SELECT doc_id, path, rule, 'group', 'Ungroup', '', true FROM ({HEURISTIC}) WHERE rule = 'heuristic.single-child-group')"""


def fingerprint_sql(*parts: str) -> str:
    """FNV-1a 64 over ASCII texts with a zero byte between, in 128-bit numbers."""
    return (
        "lpad(lower(to_hex((list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(concat("
        + ", chr(1), ".join(parts)
        + "), ''), lambda x: CASE WHEN x = chr(1) THEN 0 ELSE ascii(x) END::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))::UBIGINT)), 16, '0')"
    )


_says = lambda rule: report.MESSAGES[rule].replace("'", "''")
_RULE_ROWS = ", ".join(f"('{r[0]}', '{r[1]}', '{'convention' if r[0] == 'profile.deprecated-term' else report.BASES[r[1]]}', '{_says(r[0])}', {k})" for k, r in enumerate(RULES, 1))
_SAID = "says || coalesce(': ' || written, '')"
_PLACE = "path || coalesce('.' || CASE slot WHEN 'left' THEN 'leftOperand' WHEN 'value' THEN 'rightOperand[0]' ELSE slot END, '')"
ORACLES["h22_fingerprint"] = f"{M} SELECT doc_id, policy_ix, path, rule, {fingerprint_sql('rule', 'path', chr(39) * 2)} AS fingerprint FROM structural"
ORACLES["r2_report_json"] = f"""{FOUND}, {FIXES},
catalogue(rule, tier, basis, says, place) AS (VALUES {_RULE_ROWS}),
every AS (SELECT doc_id, path, slot, rule, written, iri, NULL::VARCHAR AS left_iri, false AS closed FROM judged WHERE rule IS NOT NULL
  UNION ALL SELECT doc_id, path, slot, 'profile.deprecated-term', written, iri, NULL::VARCHAR, false FROM wide WHERE term_deprecated
  UNION ALL SELECT doc_id, concat('policy[', policy_ix, ']'), NULL, 'profile.not-loaded', profile, profile, NULL::VARCHAR, false FROM policies JOIN gaps USING (doc_id, policy_ix)
  UNION ALL SELECT doc_id, path, NULL::VARCHAR, rule, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, false FROM structural
  UNION ALL SELECT h.doc_id, h.path, CASE rule WHEN 'prose.operator-not-allowed' THEN 'operator' WHEN 'prose.unit-not-allowed' THEN 'unit' ELSE 'value' END, rule, written, NULL::VARCHAR, left_iri, closed FROM hinted h JOIN hc USING (doc_id, path)),
mended AS (SELECT doc_id, path, rule, slot, list(DISTINCT {{'label': label, 'safe': safe, 'replacement': replacement}} ORDER BY {{'label': label, 'safe': safe, 'replacement': replacement}}) AS fixes FROM fixes GROUP BY ALL),
allows AS (SELECT left_iri, any_value(h.datatype) AS datatype FROM (SELECT left_iri FROM hints UNION SELECT left_iri FROM hint_operators UNION SELECT left_iri FROM hint_values UNION SELECT left_iri FROM hint_units) LEFT JOIN hints h USING (left_iri) GROUP BY left_iri),
ops AS (SELECT left_iri, list(op ORDER BY op) AS operators FROM hint_operators GROUP BY left_iri),
vals AS (SELECT left_iri, list(value ORDER BY ix, value) AS vals FROM hint_values GROUP BY left_iri),
unis AS (SELECT left_iri, list(unit ORDER BY unit) AS units FROM hint_units GROUP BY left_iri),
told AS (SELECT e.doc_id, [{order_sql("e.path")}, [[CASE WHEN e.rule = 'profile.not-loaded' THEN 0 WHEN tier = 'odrl' THEN 100 + place WHEN tier = 'profile' THEN 200 + coalesce(list_position({list(SLOTS)}, e.slot), 0) ELSE 300 + place END, 0]]] AS ord, e.rule AS r, coalesce(written, '') AS w,
    {{'rule': e.rule, 'tier': tier, 'basis': basis, 'severity': l.severity, 'message': {_SAID}, 'target': {{'kind': CASE WHEN e.slot IS NULL THEN 'node' ELSE 'slot' END, 'path': {_PLACE.replace("path", "e.path").replace("slot", "e.slot")}}}, 'pointer': NULL::VARCHAR,
      'term': CASE WHEN written IS NOT NULL THEN {{'written': written, 'iri': iri}} END, 'profile': CASE WHEN e.rule = 'profile.not-loaded' THEN written END,
      'expected': CASE WHEN tier = 'prose' AND e.rule <> 'prose.ill-typed-literal' THEN {{'kinds': []::VARCHAR[], 'operators': CASE WHEN e.rule = 'prose.operator-not-allowed' THEN coalesce(operators, []) ELSE [] END,
        'values': CASE WHEN e.rule IN ('prose.value-not-allowed', 'prose.iri-expected') THEN coalesce(vals[1:8], []) ELSE [] END, 'units': CASE WHEN e.rule = 'prose.unit-not-allowed' THEN coalesce(units, []) ELSE [] END,
        'datatype': CASE WHEN e.rule IN ('prose.datatype-lexical', 'prose.datatype-conflict') THEN a.datatype END, 'closed': e.closed, 'valuesTotal': CASE WHEN e.rule IN ('prose.value-not-allowed', 'prose.iri-expected') AND len(vals) > 8 THEN len(vals)::INT END}} END,
      'fixes': coalesce(m.fixes, []), 'fingerprint': {fingerprint_sql("e.rule", _PLACE.replace("path", "e.path").replace("slot", "e.slot"), f"coalesce(written, {_SAID})")}}} AS f
  FROM every e JOIN catalogue USING (rule) JOIN levels l ON l.rule = e.rule AND l.closed = e.closed AND l.severity <> 'off' LEFT JOIN mended m ON m.doc_id = e.doc_id AND m.path = e.path AND m.rule = e.rule AND m.slot IS NOT DISTINCT FROM e.slot
    LEFT JOIN allows a ON a.left_iri = e.left_iri AND tier = 'prose' LEFT JOIN ops ON ops.left_iri = a.left_iri LEFT JOIN vals ON vals.left_iri = a.left_iri LEFT JOIN unis ON unis.left_iri = a.left_iri),
found AS (SELECT doc_id, list(f ORDER BY ord, r, w) AS findings FROM told GROUP BY doc_id),
g AS (SELECT doc_id, rule, coalesce(written, path) AS detail, min({order_sql("path")}) AS at_ FROM findings WHERE gap GROUP BY ALL),
gl AS (SELECT doc_id, list({{'rule': rule, 'detail': detail}} ORDER BY at_, rule, detail) AS gaps FROM g GROUP BY doc_id),
counted AS (SELECT doc_id, CASE WHEN bool_or(coalesce(severity = 'error' AND NOT gap, false)) THEN 'violations' WHEN bool_or(coalesce(gap, false)) THEN 'incomplete' ELSE 'conforms' END AS verdict,
    count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info FROM (SELECT DISTINCT doc_id FROM policies) LEFT JOIN findings USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(to_json({{'schema': 'policy-report@1', 'tool': {{'name': 'clausework', 'version': '1'}}, 'mode': 'strict', 'tiers': ['profile', 'odrl', 'prose', 'input'], 'ruleset': 2, 'verdict': verdict,
    'vocabulary': {{'odrl': 'common', 'profiles': (SELECT list({{'iri': iri, 'title': NULL::VARCHAR, 'version': NULL::VARCHAR}} ORDER BY load_order) FROM profiles)}}, 'gaps': coalesce(gaps, []),
    'counts': {{'error': n_error, 'warning': n_warning, 'info': n_info}}, 'findings': coalesce(findings, [])}}) AS VARCHAR) AS report FROM counted LEFT JOIN found USING (doc_id) LEFT JOIN gl USING (doc_id)"""
ORACLES["d14_expected_values_full"] = ORACLES["d14_expected_values"]
