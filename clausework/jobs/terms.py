"""Queries over term uses, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.corpus import Corpus, ctes
from clausework.model import ODRL
from clausework.operators import resolve


def _uses(c: Corpus) -> DataFrame:
    return resolve.term_uses(c.policies, c.rules, c.constraints)


def _expanded(c: Corpus) -> DataFrame:
    return resolve.expand_terms(_uses(c), c.prefixes, c.profiles)


USES = """uses AS (
  SELECT doc_id, policy_ix, concat('policy[', policy_ix, ']') AS path, 'kind' AS slot, kind AS written FROM policies WHERE kind IS NOT NULL
  UNION ALL SELECT doc_id, policy_ix, concat('policy[', policy_ix, ']'), 'conflict', conflict FROM policies WHERE conflict IS NOT NULL
  UNION ALL SELECT doc_id, policy_ix, concat('policy[', policy_ix, ']'), 'action', action FROM policies WHERE action IS NOT NULL
  UNION ALL SELECT doc_id, policy_ix, path, 'action', action FROM rules WHERE action IS NOT NULL
  UNION ALL SELECT doc_id, policy_ix, path, 'left', lft FROM constraints WHERE lft IS NOT NULL
  UNION ALL SELECT doc_id, policy_ix, path, 'operator', operator FROM constraints
  UNION ALL SELECT doc_id, policy_ix, path, 'value', raw FROM constraints WHERE right_kind = 'iri' AND raw <> ''
  UNION ALL SELECT doc_id, policy_ix, path, 'unit', unit FROM constraints WHERE unit IS NOT NULL),
expanded AS (
  SELECT u.*, CASE WHEN written NOT LIKE '%:%' THEN 'bare' WHEN substr(written, strpos(written, ':') + 1, 2) = '//' OR split_part(written, ':', 1) = '_' THEN 'whole'
      WHEN p.namespace IS NOT NULL THEN 'document' WHEN written LIKE 'odrl:%' THEN 'odrl' WHEN f.namespace IS NOT NULL THEN 'profile' ELSE 'nothing' END AS expanded_by,
    CASE WHEN written NOT LIKE '%:%' THEN 'http://www.w3.org/ns/odrl/2/' || written
      WHEN substr(written, strpos(written, ':') + 1, 2) = '//' THEN written
      WHEN p.namespace IS NOT NULL THEN p.namespace || substr(written, strpos(written, ':') + 1)
      WHEN written LIKE 'odrl:%' THEN 'http://www.w3.org/ns/odrl/2/' || substr(written, 6)
      WHEN f.namespace IS NOT NULL THEN f.namespace || substr(written, strpos(written, ':') + 1) ELSE written END AS iri
  FROM uses u LEFT JOIN prefixes p ON p.doc_id = u.doc_id AND p.prefix = split_part(written, ':', 1) AND written LIKE '%:%'
  LEFT JOIN profiles f ON f.prefix = split_part(written, ':', 1) AND written LIKE '%:%'),
firsts AS (SELECT iri, arg_min(profile_id, load_order * 1000 + term_ix) AS profile_id, arg_min(kind, load_order * 1000 + term_ix) AS term_kind,
    arg_min(deprecated, load_order * 1000 + term_ix) AS term_deprecated FROM terms GROUP BY iri),
gaps AS (SELECT doc_id, policy_ix FROM policies WHERE profile IS NOT NULL AND rtrim(profile, '#/') NOT IN (SELECT rtrim(iri, '#/') FROM profiles))"""
ALL = ("policies", "rules", "constraints", "prefixes", "profiles", "terms", "odrl_terms")
BASE = f"{ctes(*ALL)},\n{USES}"

QUERIES = {
    "term_uses": lambda c: _uses(c).groupBy("slot", "written").agg(F.count("*").alias("n")),
    "c1_expand_terms": lambda c: _expanded(c).groupBy("slot", "written", "iri", "expanded_by").agg(F.count("*").alias("n")),
    "c2_resolve_terms": lambda c: resolve.resolve_terms(_expanded(c), c.terms)
    .groupBy("slot", "iri", "profile_id", "term_kind", "term_deprecated")
    .agg(F.count("*").alias("n")),
    "c3_resolve_odrl": lambda c: resolve.resolve_odrl(_expanded(c), c.odrl_terms).groupBy("iri", "odrl_kind", "odrl_deprecated").agg(F.count("*").alias("n")),
    "c8_uncovered_profiles": lambda c: resolve.covered_profiles(c.policies, c.profiles).where("not covered").select("doc_id", "policy_ix", "profile"),
    "c9_unloaded_imports": lambda c: resolve.unloaded_imports(c.imports, c.profiles),
    "c10_undeclared_in_namespace": lambda c: resolve.namespace_owner(resolve.resolve_terms(_expanded(c), c.terms).where("profile_id is null"), c.terms)
    .where("owner is not null")
    .select("doc_id", "policy_ix", "path", "slot", "written", "owner"),
    "c11_term_kinds": lambda c: resolve.term_kinds(_expanded(c).select("iri").distinct(), c.terms, c.odrl_terms).select(
        "iri", F.array_join("kinds", ",").alias("kinds")
    ),
    "c12_undeclared_profiles": lambda c: resolve.undeclared_profiles(_expanded(c), c.policies, c.terms, c.profiles)
    .where("not declares")
    .select("doc_id", "policy_ix", "path", "slot", "written"),
    "profile_rules": lambda c: resolve.term_findings(_uses(c), c.policies, c.prefixes, c.profiles, c.terms, c.odrl_terms),
    "e1_first_loaded": lambda c: resolve.first_loaded(c.terms),
}

ORACLES = {
    "term_uses": f"{BASE} SELECT slot, written, count(*) AS n FROM uses GROUP BY ALL",
    "c1_expand_terms": f"{BASE} SELECT slot, written, iri, expanded_by, count(*) AS n FROM expanded GROUP BY ALL",
    "c2_resolve_terms": f"{BASE} SELECT slot, e.iri, profile_id, term_kind, term_deprecated, count(*) AS n FROM expanded e LEFT JOIN firsts USING (iri) GROUP BY ALL",
    "c3_resolve_odrl": f"{BASE} SELECT e.iri, o.kind AS odrl_kind, o.deprecated AS odrl_deprecated, count(*) AS n FROM expanded e LEFT JOIN odrl_terms o USING (iri) GROUP BY ALL",
    "c8_uncovered_profiles": f"{BASE} SELECT doc_id, policy_ix, profile FROM policies JOIN gaps USING (doc_id, policy_ix)",
    "c9_unloaded_imports": f"{ctes('imports', 'profiles')} SELECT DISTINCT profile_id, import_iri FROM imports WHERE rtrim(import_iri, '#/') <> '{ODRL.rstrip('/')}' "
    "AND rtrim(import_iri, '#/') NOT IN (SELECT rtrim(iri, '#/') FROM profiles)",
    "c10_undeclared_in_namespace": f"""{BASE}, owners AS (SELECT regexp_extract(iri, '^.*[#/]') AS ns, arg_min(profile_id, load_order) AS owner FROM terms GROUP BY 1)
      SELECT doc_id, policy_ix, path, slot, written, owner FROM expanded e JOIN owners ON ns = regexp_extract(e.iri, '^.*[#/]') WHERE e.iri NOT IN (SELECT iri FROM terms)""",
    "c11_term_kinds": f"""{BASE}, k AS (SELECT iri, kind FROM terms UNION SELECT iri, kind FROM odrl_terms)
      SELECT e.iri, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT iri FROM expanded) e LEFT JOIN k USING (iri) GROUP BY e.iri""",
    "c12_undeclared_profiles": f"""{BASE} SELECT e.doc_id, e.policy_ix, path, slot, written FROM expanded e JOIN policies q USING (doc_id, policy_ix)
      WHERE e.iri IN (SELECT iri FROM terms) AND NOT EXISTS (SELECT 1 FROM terms t JOIN profiles f USING (profile_id) WHERE t.iri = e.iri AND rtrim(f.iri, '#/') = rtrim(q.profile, '#/'))""",
    "profile_rules": f"""{BASE},
      wide AS (SELECT e.*, r.profile_id, r.term_deprecated, o.deprecated AS odrl_deprecated, g.doc_id IS NOT NULL AS unsure,
          EXISTS (SELECT 1 FROM terms t WHERE regexp_extract(t.iri, '^.*[#/]') = regexp_extract(e.iri, '^.*[#/]')) AS owned,
          EXISTS (SELECT 1 FROM terms t WHERE t.iri = e.iri) OR o.iri IS NOT NULL AS known,
          CASE slot WHEN 'kind' THEN 'PolicyClass' WHEN 'conflict' THEN 'ConflictTerm' WHEN 'action' THEN 'Action' WHEN 'left' THEN 'LeftOperand' WHEN 'operator' THEN 'Operator' END AS want,
          EXISTS (SELECT 1 FROM terms t JOIN profiles f USING (profile_id) WHERE t.iri = e.iri AND rtrim(f.iri, '#/') = rtrim(q.profile, '#/')) AS declares
        FROM expanded e JOIN policies q ON q.doc_id = e.doc_id AND q.policy_ix = e.policy_ix LEFT JOIN firsts r ON r.iri = e.iri LEFT JOIN odrl_terms o ON o.iri = e.iri
        LEFT JOIN gaps g ON g.doc_id = e.doc_id AND g.policy_ix = e.policy_ix),
      judged AS (SELECT *, CASE
          WHEN profile_id IS NULL AND slot IN ('action', 'left', 'operator', 'value') AND owned THEN CASE WHEN NOT unsure THEN 'profile.undeclared-in-namespace' END
          WHEN expanded_by = 'profile' THEN 'profile.unbound-prefix'
          WHEN NOT known THEN CASE WHEN slot IN ('value', 'unit') OR unsure THEN NULL WHEN slot = 'conflict' THEN 'profile.conflict-term' ELSE 'profile.unknown-term' END
          WHEN want IS NOT NULL AND NOT EXISTS (SELECT 1 FROM terms t WHERE t.iri = wide.iri AND t.kind = want)
            AND NOT EXISTS (SELECT 1 FROM odrl_terms t WHERE t.iri = wide.iri AND t.kind = want)
            THEN CASE WHEN unsure THEN NULL WHEN slot = 'conflict' THEN 'profile.conflict-term' ELSE 'profile.wrong-kind' END
          WHEN profile_id IS NOT NULL AND NOT unsure AND NOT declares THEN 'profile.not-declared'
          WHEN profile_id IS NULL AND odrl_deprecated THEN 'profile.deprecated-term' END AS rule FROM wide)
      SELECT doc_id, policy_ix, path, slot, rule, written FROM judged WHERE rule IS NOT NULL
      UNION ALL SELECT doc_id, policy_ix, path, slot, 'profile.deprecated-term', written FROM wide WHERE term_deprecated""",
    "e1_first_loaded": f"{ctes('terms')} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY iri ORDER BY load_order, term_ix) AS rn FROM terms) WHERE rn = 1",
}
