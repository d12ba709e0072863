"""Queries over vocabularies derived from parts, over flattened documents and over the edit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.corpus import Corpus, ctes
from clausework.jobs.rules import M
from clausework.model import COMMON_TERMS, CORE_TERMS
from clausework.operators import resolve, rewrite, vocabulary
from clausework.sources import flatten

# Triples of parts, brands and types; both engines read this text.
TRIPLES = """
SELECT concat('g', cast(p_partkey % 3 AS string)) AS graph_id, p_partkey * 10 AS seq, concat('urn:part:', cast(p_partkey AS string)) AS s, 'rdf:type' AS p,
  CASE p_size % 4 WHEN 0 THEN 'Action' WHEN 1 THEN 'LeftOperand' WHEN 2 THEN concat('urn:kind:', p_type) ELSE 'RightOperand' END AS o_iri, cast(NULL AS string) AS o_value, cast(NULL AS string) AS o_lang FROM {part}
UNION ALL SELECT concat('g', cast(p_partkey % 3 AS string)), p_partkey * 10 + 1, concat('urn:part:', cast(p_partkey AS string)), 'skos:broader', concat('urn:brand:', p_brand), NULL, NULL FROM {part}
UNION ALL SELECT concat('g', cast(p_partkey % 3 AS string)), p_partkey * 10 + 2, concat('urn:part:', cast(p_partkey AS string)), 'rdfs:label', NULL, p_name,
  CASE p_partkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'en-GB' WHEN 4 THEN 'fr' END FROM {part}
UNION ALL SELECT concat('g', cast(p_partkey % 3 AS string)), p_partkey * 10 + 3, concat('urn:part:', cast(p_partkey AS string)), 'skos:prefLabel', NULL, concat('The ', p_name),
  CASE p_partkey % 4 WHEN 0 THEN 'de-AT' WHEN 1 THEN 'en' WHEN 2 THEN 'de' END FROM {part} WHERE p_partkey % 3 <> 0
UNION ALL SELECT concat('g', cast(p_partkey % 3 AS string)), p_partkey * 10 + 4, concat('urn:part:', cast(p_partkey AS string)), 'rdfs:isDefinedBy', concat('urn:profile:', cast(p_partkey % 7 AS string)), NULL, NULL FROM {part}
UNION ALL SELECT concat('g', cast(p_partkey % 3 AS string)), p_partkey * 10 + 5, concat('urn:part:', cast(p_partkey AS string)), 'rdfs:label', NULL, concat(p_name, ' (2)'), 'de' FROM {part} WHERE p_partkey % 4 = 0
"""
EDGES = """
SELECT DISTINCT concat('urn:brand:', p_brand) AS child, concat('urn:kind:', p_type) AS parent FROM {part}
UNION SELECT DISTINCT concat('urn:kind:', p_type) AS child, CASE WHEN p_type < 'M' THEN 'Action' ELSE 'RightOperand' END AS parent FROM {part}
UNION SELECT concat('urn:part:', cast(p_partkey AS string)), concat('urn:brand:', p_brand) FROM {part}
"""
LOG = """
SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'SetText' WHEN 'error' THEN 'Remove' WHEN 'click' THEN 'SetChoice' WHEN 'view' THEN 'SetIri' ELSE 'Add' END AS op,
  concat('slot', cast(event_id % 7 AS string)) AS slot, concat('v', cast(event_id AS string)) AS value, CASE WHEN event_id % 11 = 0 THEN event_id % 50 END AS expect FROM {events}
"""
PREFIX_ROWS = "SELECT * FROM (VALUES ('a', 'https://example.org/'), ('ab', 'https://example.org/a#'), ('ex', 'https://example.org/a#'), ('p', 'urn:party:')) AS t(prefix, namespace)"


def _triples(c: Corpus) -> DataFrame:
    return c.spark.sql(TRIPLES, part=c.part)


def _edges(c: Corpus) -> DataFrame:
    return c.spark.sql(EDGES, part=c.part)


def _texts(c: Corpus) -> DataFrame:
    return _triples(c).where("o_value is not null").select("s", "p", F.col("o_value").alias("text"), F.col("o_lang").alias("lang"), F.col("seq").alias("ix"))


def _log(c: Corpus) -> DataFrame:
    return c.spark.sql(LOG, events=c.events)


def _kinds(c: Corpus) -> DataFrame:
    types = _triples(c).where("p = 'rdf:type'").select(F.col("s").alias("iri"), F.col("o_iri").alias("kind"))
    return vocabulary.derived_kinds(types, _edges(c), ["Action", "LeftOperand", "RightOperand"])


def _tree(c: Corpus) -> DataFrame:
    roots = _edges(c).where("parent like 'urn:kind:%'").select(F.col("parent").alias("iri")).distinct()
    return vocabulary.descendants(_edges(c), roots)


def _ntriples(c: Corpus) -> DataFrame:
    t = _triples(c)
    o = F.when(F.col("o_iri").isNotNull(), F.concat(F.lit("<"), F.col("o_iri"), F.lit(">"))).otherwise(
        F.concat(F.lit('"'), F.col("o_value"), F.lit('"'), F.coalesce(F.concat(F.lit("@"), F.col("o_lang")), F.lit("")))
    )
    lines = t.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))
    return vocabulary.read_ntriples(lines).select("s", "p", "o_iri", "o_value", "o_lang")


def _flat(c: Corpus, *columns: str) -> DataFrame:
    docs = flatten.documents_json(c.policies, c.rules).select((F.col("doc_id") * 1000 + F.col("policy_ix")).alias("doc_id"), "text")
    return flatten.flatten(docs, *columns)


def _rules_of(flat: DataFrame) -> DataFrame:
    """doc_id, list, path, assigner, assignee, target, action from flattened rows."""
    inside = flat.where(F.col("parent").rlike(r"^(permission|prohibition|obligation)\[\d+\]$"))
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return inside.groupBy("doc_id", "parent").agg(value("uid").alias("path"), *[value(k).alias(k) for k in ("assigner", "assignee", "target", "action")]).withColumn(
        "list", F.regexp_extract("parent", "^[a-z]+", 0)
    ).drop("parent")


def _nodes(c: Corpus) -> DataFrame:
    flat = _flat(c, "doc_id", "parent", "key", "value")
    return flat.where("parent = ''").groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("key") == "@type", F.col("value"))).alias("types"))


def _keys_twice(c: Corpus) -> DataFrame:
    """Rows of nodes whose keys come in several spellings."""
    spelled = F.when(F.col("rule_ix") % 3 == 0, F.concat(F.lit("odrl:"), "list")).when(F.col("rule_ix") % 3 == 1, F.concat(F.lit("http://www.w3.org/ns/odrl/2/"), "list")).otherwise(F.col("list"))
    rows = c.rules.select("doc_id", F.col("policy_ix").cast("string").alias("parent"), spelled.alias("key"), F.col("rule_ix").alias("pos"))
    return rewrite.normalise_keys(rows).select("doc_id", "parent", "key", "pos", "bare", "kept")


def _typed(c: Corpus) -> DataFrame:
    names = [n for table in (CORE_TERMS, COMMON_TERMS) for n in table["Action"].split()]
    candidates = c.spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ix int")
    typed = c.rules.where("action is not null").select(F.concat(F.substring_index("action", ":", -1), F.when(F.col("rule_ix") % 3 == 0, "e").when(F.col("rule_ix") % 3 == 1, "").otherwise("xy")).alias("written"))
    return vocabulary.nearest_term(typed, candidates)


def _refs(c: Corpus) -> DataFrame:
    nodes = c.policies.select("doc_id", F.col("policy_ix").alias("id"), F.col("parent_ix").alias("ref"))
    return vocabulary.resolve_references(nodes)


QUERIES = {
    "a5_ntriples": _ntriples,
    "a8_classify_text": lambda c: c.pages.select(F.col("html").alias("t")).unionByName(c.events.select(F.col("props").alias("t"))).unionByName(c.documents.select(F.col("text").alias("t"))).select(
        vocabulary.classify_text(F.col("t")).alias("kind")
    ).groupBy("kind").agg(F.count("*").alias("n")),
    "e2_best_language": lambda c: vocabulary.best_language(_texts(c), ["s"], ["de-AT", "fr"]),
    "e3_fallback_text": lambda c: vocabulary.fallback_text(_texts(c), ["s"], ["skos:prefLabel", "rdfs:label"]).select("s", "p", "text"),
    "g1_derived_kinds": _kinds,
    "g2_value_trees": _tree,
    "d10_profile_summary": lambda c: vocabulary.profile_summary(_triples(c).where("p = 'rdf:type'").select(F.col("graph_id").alias("profile_id"), F.col("o_iri").alias("kind"))),
    "d11_most_defined_by": lambda c: vocabulary.most_defined_by(_triples(c)),
    "d12_profile_conflicts": lambda c: vocabulary.profile_conflicts(c.terms),
    "u1_merge_vocabulary": lambda c: vocabulary.merge_vocabulary(c.terms.select("iri", "kind"), c.odrl_terms.select("iri", "kind"), "iri"),
    "u3_same_vocabulary": lambda c: vocabulary.same_rows(
        _triples(c).where("p <> 'rdfs:isDefinedBy'").select("s", "p", "o_iri"), _triples(c).where("p <> 'rdf:type'").select("s", "p", "o_iri")
    ),
    "c4_resolve_references": _refs,
    "c6_declared_labels": lambda c: vocabulary.declared_labels(
        c.part.select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("iri"), F.concat("p_brand", F.lit(" "), "p_type").alias("label"), F.col("p_partkey").alias("ix"))
    ),
    "c17_compact_iris": lambda c: vocabulary.compact_iris(
        resolve.expand_terms(resolve.term_uses(c.policies, c.rules, c.constraints), c.prefixes, c.profiles).select("iri").unionByName(c.policies.where("assignee is not null").select(F.col("assignee").alias("iri"))).distinct(),
        c.spark.sql(PREFIX_ROWS),
    ),
    "c18_nearest_term": _typed,
    "a2_flatten_rules": lambda c: _rules_of(_flat(c, "doc_id", "parent", "key", "value")),
    "a3_json_keys": lambda c: _flat(c, "key", "kind").where("key is not null").groupBy("key", "kind").agg(F.count("*").alias("n")),
    "b1_is_policy": lambda c: _nodes(c).groupBy(rewrite.is_policy(F.col("types"), F.col("keys")).alias("policy"), rewrite.policy_kind(F.col("types")).alias("kind")).agg(F.count("*").alias("n")),
    "b3_normalise_keys": _keys_twice,
    "b5_unknown_keys": lambda c: rewrite.unknown_keys(c.events.select(F.col("event_id").alias("doc_id"), F.lit("").alias("path"), F.explode(F.json_object_keys("props")).alias("key"))),
    "b9_strip_out_of_scope": lambda c: rewrite.strip_out_of_scope(_flat(c), ["prohibition", "conflict"]).where("kind not in ('object', 'list')").select("doc_id", "path", "value"),
    "b10_rewrite_policy_type": lambda c: rewrite.rewrite_policy_type(c.policies.select("doc_id", "policy_ix", "kind"), ["Offer", "Agreement"]),
    "b13_limit_violations": lambda c: rewrite.limit_violations(
        c.rules.select("doc_id", F.col("policy_ix").alias("owner"), "list"), c.spark.createDataFrame([("permission", 2, 5), ("prohibition", 0, 1), ("obligation", 1, 3)], "list string, least int, most int")
    ),
    "b14_logical_depth": lambda c: c.constraints.groupBy("doc_id", rewrite.logical_depth(F.col("path")).alias("depth")).agg(F.count("*").alias("n")),
    "s1_latest_edits": lambda c: rewrite.latest_edits(_log(c)),
    "s1_stale_edits": lambda c: rewrite.stale_edits(_log(c)),
    "s1_replay_edits": lambda c: rewrite.replay_edits(_log(c)),
}

T = f"WITH RECURSIVE triples AS ({TRIPLES.format(part='part')}), edges AS ({EDGES.format(part='part')})"
L = f"WITH log AS ({LOG.format(events='events')})"
# A document's slots and their values as two lists, an edit a round.
REPLAY = f"""WITH RECURSIVE log AS ({LOG.format(events='events')}), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM log),
  r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS version, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS slots, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op,
      CAST(NULL AS BIGINT) AS expect, false AS accepted, CAST(0 AS BIGINT) AS before, CAST(NULL AS VARCHAR) AS slot FROM log
    UNION ALL SELECT doc_id, rn, before + accepted::INT, CASE WHEN NOT accepted THEN slots WHEN op = 'Remove' THEN map_from_entries(list_filter(map_entries(slots), lambda x: x.key <> slot))
        ELSE map_concat(slots, MAP {{slot: value}}) END, seq, op, expect, accepted, before, slot
      FROM (SELECT e.*, r.slots, r.version AS before, (e.expect IS NULL OR e.expect = r.version) AND (e.op LIKE 'Set%' OR (e.op = 'Remove' AND map_contains(r.slots, e.slot)) OR (e.op = 'Add' AND NOT map_contains(r.slots, e.slot))) AS accepted
        FROM r JOIN e ON e.doc_id = r.doc_id AND e.rn = r.rn + 1)),
  told AS (SELECT doc_id, seq, op, expect, accepted, before, version, slot, slots[slot] AS value FROM r WHERE rn > 0)"""
DOWN = """down AS (SELECT DISTINCT parent AS root, parent AS iri, 0 AS depth FROM edges {0}
  UNION SELECT d.root, e.child, d.depth + 1 FROM down d JOIN edges e ON e.parent = d.iri)"""
_NAMES = ", ".join(f"('{n}', {i})" for i, n in enumerate([n for t in (CORE_TERMS, COMMON_TERMS) for n in t["Action"].split()]))
JSON_KEYS = f"""{ctes("policies", "rules")}"""

ORACLES = {
    "a5_ntriples": f"{T} SELECT s, p, o_iri, o_value, o_lang FROM triples",
    "a8_classify_text": """SELECT kind, count(*) AS n FROM (SELECT 'html' AS kind FROM pages WHERE html ILIKE '<!doctype html%' UNION ALL SELECT 'json' FROM events WHERE props LIKE '{%'
      UNION ALL SELECT CASE WHEN coalesce(ltrim(text), '') = '' THEN 'empty' ELSE 'other' END FROM documents) GROUP BY kind""",
    "e2_best_language": f"""{T}, r AS (SELECT s, o_value, row_number() OVER (PARTITION BY s ORDER BY CASE lower(coalesce(o_lang, '')) WHEN 'de-at' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 3 WHEN 'en' THEN 5 WHEN '' THEN 6 ELSE 7 END, seq) AS rn
      FROM triples WHERE o_value IS NOT NULL) SELECT s, o_value AS text FROM r WHERE rn = 1""",
    "e3_fallback_text": f"{T} SELECT s, p, o_value AS text FROM triples t WHERE o_value IS NOT NULL AND (p = 'skos:prefLabel' OR s NOT IN (SELECT s FROM triples WHERE p = 'skos:prefLabel'))",
    "g1_derived_kinds": f"""{T}, {DOWN.format("WHERE parent IN ('Action', 'LeftOperand', 'RightOperand')")} SELECT DISTINCT s AS iri, coalesce(root, o_iri) AS kind FROM triples LEFT JOIN down ON iri = o_iri AND depth > 0
      WHERE p = 'rdf:type' AND (root IS NOT NULL OR o_iri IN ('Action', 'LeftOperand', 'RightOperand'))""",
    "g2_value_trees": f"{T}, {DOWN.format("WHERE parent LIKE 'urn:kind:%'")} SELECT root, iri, min(depth) AS depth FROM down WHERE depth > 0 GROUP BY root, iri",
    "d10_profile_summary": f"{T} SELECT graph_id AS profile_id, o_iri AS kind, count(*) AS n FROM triples WHERE p = 'rdf:type' GROUP BY ALL",
    "d11_most_defined_by": f"""{T}, n AS (SELECT graph_id, o_iri, count(*) AS n, min(seq) AS first FROM triples WHERE p = 'rdfs:isDefinedBy' GROUP BY ALL)
      SELECT graph_id, o_iri AS iri FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, first) AS rn FROM n) WHERE rn = 1""",
    "d12_profile_conflicts": f"{ctes('terms')} SELECT DISTINCT b.iri, a.profile_id AS first_profile, b.profile_id AS other_profile FROM terms a JOIN terms b ON a.iri = b.iri AND a.load_order < b.load_order",
    "u1_merge_vocabulary": f"{ctes('terms', 'odrl_terms')} SELECT iri, kind, 0 AS part FROM terms UNION ALL SELECT iri, kind, 1 FROM odrl_terms WHERE iri NOT IN (SELECT iri FROM terms)",
    "u3_same_vocabulary": f"{T} SELECT s, p, o_iri, CASE p WHEN 'rdf:type' THEN 'a' ELSE 'b' END AS only_in FROM triples WHERE p IN ('rdf:type', 'rdfs:isDefinedBy')",
    "c4_resolve_references": f"""{ctes("policies")}, chase AS (SELECT doc_id, policy_ix AS id, policy_ix AS now, parent_ix AS next, 0 AS k FROM policies
      UNION ALL SELECT c.doc_id, c.id, p.policy_ix, p.parent_ix, k + 1 FROM chase c JOIN policies p ON p.doc_id = c.doc_id AND p.policy_ix = c.next WHERE k < 40)
      SELECT doc_id, id, max(CASE WHEN next IS NULL THEN now WHEN NOT EXISTS (SELECT 1 FROM policies p WHERE p.doc_id = chase.doc_id AND p.policy_ix = chase.next) THEN next END) AS target FROM chase GROUP BY doc_id, id""",
    "c6_declared_labels": """WITH l AS (SELECT p_size AS doc_id, p_partkey AS iri, p_brand || ' ' || p_type AS label FROM part)
      SELECT doc_id, min(iri) AS iri, label FROM l GROUP BY doc_id, label HAVING count(DISTINCT iri) = 1""",
    "c17_compact_iris": f"""{M}, i AS (SELECT iri FROM expanded UNION SELECT assignee FROM policies WHERE assignee IS NOT NULL), pre AS ({PREFIX_ROWS}),
      b AS (SELECT iri, prefix || ':' || substr(iri, length(namespace) + 1) AS c, row_number() OVER (PARTITION BY iri ORDER BY length(namespace) DESC, prefix DESC) AS rn FROM i JOIN pre ON starts_with(iri, namespace)
        WHERE regexp_full_match(substr(iri, length(namespace) + 1), '[A-Za-z0-9_.-]+'))
      SELECT i.iri, CASE WHEN starts_with(i.iri, 'http://www.w3.org/ns/odrl/2/') THEN substr(i.iri, 29) ELSE c END AS compact FROM i LEFT JOIN b ON b.iri = i.iri AND rn = 1""",
    "c18_nearest_term": f"""{ctes("rules")}, cand AS (SELECT * FROM (VALUES {_NAMES}) AS t(name, ix)), w AS (SELECT DISTINCT split_part(action, ':', -1) || CASE rule_ix % 3 WHEN 0 THEN 'e' WHEN 1 THEN '' ELSE 'xy' END AS written FROM rules WHERE action IS NOT NULL),
      d AS (SELECT written, name, ix, levenshtein(written, name) AS distance FROM w, cand) SELECT written, name AS candidate, distance FROM (SELECT *, row_number() OVER (PARTITION BY written ORDER BY distance, ix) AS rn FROM d
        WHERE distance <= greatest(1, (length(written) + 1) // 3) AND distance < length(written)) WHERE rn = 1""",
    "a2_flatten_rules": f"{ctes('rules')} SELECT doc_id * 1000 + policy_ix AS doc_id, path, list, assigner, assignee, target, action FROM rules",
    "b1_is_policy": f"""{ctes("policies", "rules")} SELECT (kind IS NOT NULL AND kind <> 'ex:ResearchAgreement') OR (doc_id, policy_ix) IN (SELECT (doc_id, policy_ix) FROM rules) AS policy,
      CASE WHEN kind IS NULL THEN 'Set' ELSE split_part(kind, ':', -1) END AS kind, count(*) AS n FROM policies GROUP BY ALL""",
    "b3_normalise_keys": f"""{ctes("rules")}, k AS (SELECT doc_id, cast(policy_ix AS VARCHAR) AS parent, CASE rule_ix % 3 WHEN 0 THEN 'odrl:' || list WHEN 1 THEN 'http://www.w3.org/ns/odrl/2/' || list ELSE list END AS key, rule_ix AS pos, list AS bare FROM rules)
      SELECT *, row_number() OVER (PARTITION BY doc_id, parent, bare ORDER BY (key <> bare)::INT, pos) = 1 AS kept FROM k""",
    "b5_unknown_keys": "SELECT event_id AS doc_id, '' AS path, unnest(json_keys(props)) AS key FROM events",
    "b10_rewrite_policy_type": f"""{ctes("policies")} SELECT doc_id, policy_ix, CASE WHEN kind IN ('Offer', 'Agreement') THEN kind ELSE 'Offer' END AS kind, coalesce(kind, 'Set') NOT IN ('Offer', 'Agreement') AS changed FROM policies""",
    "b13_limit_violations": f"""{ctes("rules")}, lim AS (SELECT * FROM (VALUES ('permission', 2, 5), ('prohibition', 0, 1), ('obligation', 1, 3)) AS t(list, least, most))
      SELECT doc_id, policy_ix AS owner, list, count(*) AS n, least, most FROM rules JOIN lim USING (list) GROUP BY ALL HAVING n < least OR n > most""",
    "b14_logical_depth": f"{ctes('constraints')} SELECT doc_id, CASE WHEN path LIKE '%.child[%' THEN 1 ELSE 0 END AS depth, count(*) AS n FROM constraints GROUP BY ALL",
    "s1_latest_edits": f"{L} SELECT doc_id, slot, arg_max(value, seq) AS value, count(*) FILTER (op <> 'Remove') AS n FROM log WHERE op LIKE 'Set%' OR op = 'Remove' GROUP BY ALL HAVING arg_max(op, seq) <> 'Remove'",
    "s1_stale_edits": f"{REPLAY} SELECT doc_id, seq, op, expect, before AS version FROM told WHERE expect <> before",
    "s1_replay_edits": f"{REPLAY} SELECT * FROM told",
}
