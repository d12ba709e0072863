"""Queries for lists, labels, fixes and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.corpus import Corpus, ctes
from clausework.functions import wording
from clausework.functions.paths import path_key
from clausework.jobs.rules import DUPLICATE, FOUND, HEURISTIC, M, _duplicates, _hints, _links, order_sql
from clausework.jobs.terms import BASE
from clausework.jobs.vocab import T, _edges, _triples
from clausework.model import ODRL
from clausework.operators import inherit, layers, lists, resolve, structure, vocabulary

CELLS = """
SELECT doc_id AS graph_id, concat('b', cast(policy_ix AS string), '_', cast(rule_ix AS string)) AS s, 'rdf:first' AS p, concat('urn:part:', cast(l_partkey AS string)) AS o_iri FROM {lines}
UNION ALL SELECT a.doc_id, concat('b', cast(a.policy_ix AS string), '_', cast(a.rule_ix AS string)), 'rdf:rest', concat('b', cast(a.policy_ix AS string), '_', cast(a.rule_ix + 1 AS string))
  FROM {lines} a JOIN {lines} b ON b.doc_id = a.doc_id AND b.policy_ix = a.policy_ix AND b.rule_ix = a.rule_ix + 1
"""
ALIASES = """
SELECT o_custkey AS doc_id, concat('k', cast(o_orderkey % 6 AS string)) AS key, CASE o_orderkey % 6 WHEN 0 THEN 'https://example.org/x#' ELSE concat('k', cast(o_orderkey % 6 - 1 AS string), ':t', cast(o_orderkey % 6 AS string)) END AS iri
FROM {orders} GROUP BY o_custkey, o_orderkey % 6
"""
STAMPS = """
SELECT DISTINCT CASE l_linenumber WHEN 1 THEN shipped WHEN 2 THEN concat(shipped, 'T10:00:00Z') WHEN 3 THEN concat(shipped, 'T10:30+02:00') WHEN 4 THEN concat(shipped, 'T10:30:15.5') WHEN 5 THEN concat(shipped, 'T1030') ELSE concat('x ', shipped) END AS stamp FROM {lines}
"""
PATCH = "SELECT * FROM (VALUES ('http://www.w3.org/ns/odrl/2/count', 'xsd:decimal', cast(NULL AS string)), ('https://example.org/a#purpose', NULL, '^x$')) AS t(left_iri, datatype, pattern) UNION ALL SELECT concat('https://example.org/parts#t', cast(p_partkey AS string)), NULL, '^[0-9]+$' FROM {part} WHERE p_partkey % 3 = 0"


#: For each part what its profile, an overlay, shapes and a host say of it: (operators, values, units, datatype, pattern, closed, whether they say anything).
LAYERS = {
    "profile": ("p_size % 2 = 0", "p_partkey % 3 = 0", "p_partkey % 7 = 0", "p_partkey % 5 = 0", "p_partkey % 13 = 0", "p_partkey % 11 = 0", "true"),
    "overlay": ("p_partkey % 4 = 0", "p_partkey % 6 = 0", "p_partkey % 14 = 0", "p_partkey % 10 = 0", "false", "p_partkey % 8 < 3", "p_partkey % 2 = 0"),
    "shapes": ("p_partkey % 15 = 0", "p_partkey % 5 = 0", "false", "p_partkey % 20 = 1", "p_partkey % 10 = 1", "false", "p_partkey % 5 < 2"),
    "host": ("false", "p_partkey % 9 < 2", "false", "false", "false", "p_partkey % 9 = 0", "p_partkey % 9 < 3"),
}


def _four_layers(c: Corpus) -> DataFrame:
    def side(name: str) -> DataFrame:
        operators, values, units, datatype, pattern, closed, some = LAYERS[name]
        listed = lambda test, *items: F.when(F.expr(test), F.array(*[F.lit(x) for x in items])).otherwise(F.array().cast("array<string>"))
        return c.part.where(some).select(
            F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("left_iri"), listed(operators, f"{name}-op", "eq").alias("operators"), listed(values, f"{name}-a", f"{name}-b").alias("values"),
            listed(units, f"{name}-unit").alias("units"), F.when(F.expr(datatype), f"{name}-type").alias("datatype"), F.expr(closed).alias("closed"),
            F.when(F.expr(pattern), F.struct(F.lit(f"^{name}").alias("pattern"), F.lit(None).cast("string").alias("flags"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"))).alias("lexical"),
        )

    made = layers.layered(*[side(name) for name in LAYERS])
    text = [F.array_join(x, ",").alias(x) for x in ("operators", "values", "units")]
    return made.select("left_iri", *text, F.coalesce("datatype", F.lit("")).alias("datatype"), F.coalesce("lexical.pattern", F.lit("")).alias("pattern"), "closed", "values_only", F.coalesce("src_values", F.lit("")).alias("src_values"), F.coalesce("src_operators", F.lit("")).alias("src_operators"))


def _layers_sql() -> str:
    """Four layers one after another, each facet a text; what binds is worked out from the layer before."""
    cols = ("operators", "values_", "units", "datatype", "pattern")
    of = lambda name: dict(zip((*cols, "closed", "some"), LAYERS[name], strict=True))
    text = {"operators": "'{0}-op,eq'", "values_": "'{0}-a,{0}-b'", "units": "'{0}-unit'", "datatype": "'{0}-type'", "pattern": "'^{0}'"}
    given = lambda name, c: f"(({of(name)[c]}) AND ({of(name)['some']}))"
    said = lambda name, c: f"CASE WHEN {given(name, c)} THEN {text[c].format(name)} ELSE '' END"
    sql = "WITH l0 AS (SELECT part.*, " + ", ".join(f"{said('profile', c)} AS {c}" for c in cols)
    sql += f", ({of('profile')['closed']}) AS closed, false AS only_, CASE WHEN {given('profile', 'values_')} THEN 'profile' ELSE '' END AS sv, CASE WHEN {given('profile', 'operators')} THEN 'profile' ELSE '' END AS so FROM part)"
    for k, name in enumerate(("overlay", "shapes", "host")):
        any_ = "(" + " OR ".join(given(name, c) for c in cols) + ")"
        alone = f"({given(name, 'values_')} AND NOT (" + " OR ".join(given(name, c) for c in cols if c != "values_") + "))" if name != "overlay" else "false"
        shuts = {"overlay": f"({given(name, 'closed')} AND {any_})", "shapes": any_, "host": f"({given(name, 'closed')} AND {given(name, 'values_')})"}[name]
        drops = f"({shuts} AND NOT {alone} AND NOT (closed AND NOT only_))"
        takes_values = given(name, "values_") if name != "host" else f"({given(name, 'values_')} AND (({of(name)['closed']}) OR NOT closed))"
        takes = {c: given(name, c) if name != "host" else "false" for c in cols} | {"values_": takes_values}
        pick = lambda c, takes=takes, drops=drops, name=name: f"CASE WHEN {takes[c]} THEN {text[c].format(name)} WHEN {drops}{' AND NOT closed' if c == 'values_' else ''} AND '{c}' <> 'pattern' THEN '' ELSE {c} END AS {c}"
        keeps = f"({alone} AND {shuts} AND NOT closed AND (operators <> '' OR units <> '' OR datatype <> ''))" if name != "host" else f"({shuts} AND NOT closed)"
        only = f"CASE WHEN {keeps} THEN true WHEN {shuts} AND {alone} THEN only_ WHEN {shuts} THEN false ELSE only_ END AS only_"
        shut = f"closed OR {shuts}" + (f" OR {given(name, 'closed')}" if name == "overlay" else "")
        src = f"CASE WHEN {takes['values_']} THEN '{name}' ELSE sv END AS sv, CASE WHEN {takes['operators']} THEN '{name}' ELSE so END AS so"
        sql += f", l{k + 1} AS (SELECT * REPLACE ({', '.join(pick(c) for c in cols)}, {shut} AS closed, {only}, {src}) FROM l{k})"
    return sql + " SELECT 't' || p_partkey AS left_iri, operators, values_ AS values, units, datatype, pattern, closed, only_ AS values_only, sv AS src_values, so AS src_operators FROM l3"


def _uses(c: Corpus) -> DataFrame:
    return resolve.term_uses(c.policies, c.rules, c.constraints)


def _term_findings(c: Corpus, with_iri: bool = False) -> DataFrame:
    return resolve.term_findings(_uses(c), c.policies, c.prefixes, c.profiles, c.terms, c.odrl_terms, with_iri=with_iri)


def _fixed(c: Corpus) -> DataFrame:
    """The only safe fix of a term's use writes its own IRI, so uses bring their fixes and are not met again by place."""
    uses = resolve.unbound_prefixes(_uses(c), c.prefixes, c.profiles, c.terms)
    return uses.groupBy("slot", F.when(F.col("unbound"), F.col("iri")).otherwise(F.col("written")).alias("written")).agg(F.count("*").alias("n"))


def _fixes(c: Corpus) -> DataFrame:
    expanded = resolve.expand_terms(_uses(c), c.prefixes, c.profiles)
    return lists.fixes(_term_findings(c, with_iri=True), expanded, c.terms, c.profiles, _hints(c), c.constraints, _duplicates(c), structure.heuristic_findings(c.constraints))


def _suggested(c: Corpus) -> DataFrame:
    options = c.part.select(F.col("p_partkey").alias("ix"), F.concat("p_type", F.lit(" "), "p_brand").alias("label"), F.col("p_name").alias("hint"), F.col("p_brand").alias("grp"))
    return lists.filter_suggestions(options, "ar", 500)


QUERIES = {
    "g7_walk_lists": lambda c: lists.walk_lists(c.spark.sql(CELLS, lines=c.lines)),
    "g12_resolve_aliases": lambda c: lists.resolve_aliases(c.spark.sql(ALIASES, orders=c.orders)),
    "c20_outside_host_list": lambda c: lists.outside_list(c.rules.select("doc_id", "path", "assigner"), "assigner", c.supplier.where("s_suppkey % 4 <> 0").select(F.concat(F.lit("urn:party:s"), F.col("s_suppkey").cast("string")).alias("value"))).select("doc_id", "path", "assigner"),
    "c21_outside_closed_terms": lambda c: lists.outside_list(resolve.expand_terms(_uses(c), c.prefixes, c.profiles).where("slot = 'action'").select("doc_id", "path", "iri"), "iri", c.odrl_terms.where("core").select(F.col("iri").alias("value"))).select("doc_id", "path", "iri"),
    "c22_overlay_orphans": lambda c: lists.overlay_orphans(c.hints.select("left_iri", "closed"), c.terms),
    "v5_layer_hints": lambda c: lists.layer_hints(c.hints.select("left_iri", "datatype", "pattern"), [("overlay", c.spark.sql(PATCH, part=c.part))], ["datatype", "pattern"]),
    "v5_four_layers": _four_layers,
    "e10_filter_suggestions": _suggested,
    "e9_first_declaration": lambda c: lists.first_declaration(c.rules.where("target is not null").select("doc_id", F.col("target").alias("iri"), F.struct("policy_ix", "rule_ix").alias("ord"))).select("doc_id", "iri", "ord.policy_ix", "ord.rule_ix"),
    "e7_dedupe_notes": lambda c: lists.dedupe_notes(_term_findings(c).select("doc_id", F.concat_ws(" ", "rule", "written").alias("note"), path_key(F.col("path")).alias("ord"))),
    "p9_inherited_rules": lambda c: lists.inherited_rules(c.rules, inherit.lineages(_links(c))),
    "e7_dedupe_notes_full": lambda c: lists.dedupe_notes(_term_findings(c).select("doc_id", F.concat_ws(" ", "rule", "written").alias("note"), path_key(F.col("path")).alias("ord"))),
    "p9_inherited_rules_full": lambda c: lists.inherited_rules(c.rules, inherit.lineages(_links(c))),
    "r4_fixes": _fixes,
    "r5_apply_safe_fixes": _fixed,
    "r6_admissible": lambda c: lists.admissible(*resolve.judged_terms(_uses(c), c.policies, c.prefixes, c.profiles, c.terms, c.odrl_terms)),
    "b4_prefix_is_odrl": lambda c: lists.prefix_is_odrl(c.orders.select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "odrl").otherwise("ex").alias("key"), F.when(F.col("o_orderkey") % 10 == 0, "urn:other").otherwise(ODRL).alias("iri")), ODRL),
    "v2_profile_terms": lambda c: lists.pivot_terms(_triples(c)),
    "g3_action_tree": lambda c: lists.action_tree(_edges(c).withColumn("ix", F.length("parent")), _edges(c).where("parent like 'urn:kind:%'").select(F.col("parent").alias("iri")).distinct()).select("root", "iri", F.size("path").alias("depth")),
    "g9_class_members": lambda c: lists.class_members(
        _edges(c).where("parent like 'urn:kind:%'").select(F.col("parent").alias("iri")).distinct(), _triples(c).where("p = 'rdf:type'").select(F.col("s").alias("iri"), F.col("o_iri").alias("kind")),
        vocabulary.descendants(_edges(c).where("child not like 'urn:part:%'"), _edges(c).where("parent like 'urn:kind:%'").select(F.col("parent").alias("iri")).distinct()), 100_000),
    "g8_hierarchy_cycles": lambda c: inherit.on_cycle(c.links.select(F.lit(0).alias("doc_id"), F.col("child").alias("policy_ix"), F.col("parent").alias("parent_ix"))).select(F.col("policy_ix").alias("iri")),
    "h13_when_text": lambda c: c.spark.sql(STAMPS, lines=c.lines).select("stamp", wording.when_text(F.col("stamp")).alias("told")),
    "h21_resolve_iri": lambda c: c.pages.select("page_id", *[wording.resolve_iri(F.col("url"), F.lit(r)).alias(n) for n, r in (("fragment", "#x"), ("query", "?q=1"), ("host", "//h/x"), ("root", "/x"), ("beside", "x"))]),
    "h23_slugs": lambda c: c.pages.select("page_id", wording.slug(F.concat(F.col("url"), F.lit("/examples/A b.json"))).alias("slug"), wording.title(wording.slug(F.concat(F.lit("one-two/"), F.col("page_id").cast("string")))).alias("title"), wording.cell(F.concat(F.lit(" a |\n b  "), "url")).alias("cell")),
    "h17_labels": lambda c: c.part.select(F.concat_ws(" ", F.initcap("p_type"), "p_brand").alias("label")).distinct().select("label", wording.label_in_sentence(F.col("label")).alias("inside"), wording.article(wording.label_in_sentence(F.col("label"))).alias("told")),
}

_JUDGED = FOUND[: FOUND.index("levels AS (")].rstrip().rstrip(",")
TERM_FINDINGS = f"{_JUDGED}, tf AS (SELECT doc_id, policy_ix, path, slot, rule, written FROM judged WHERE rule IS NOT NULL UNION ALL SELECT doc_id, policy_ix, path, slot, 'profile.deprecated-term', written FROM wide WHERE term_deprecated)"
ORACLES = {
    "g7_walk_lists": f"{ctes('lines')} SELECT doc_id AS graph_id, concat('b', policy_ix, '_0') AS head, rule_ix AS ix, concat('urn:part:', l_partkey) AS item FROM lines",
    "g12_resolve_aliases": f"""WITH RECURSIVE a AS ({ALIASES.format(orders="orders")}), x AS (SELECT doc_id, key, iri, 0 AS k FROM a
      UNION ALL SELECT x.doc_id, x.key, a.iri || substr(x.iri, strpos(x.iri, ':') + 1), k + 1 FROM x JOIN a ON a.doc_id = x.doc_id AND a.key = split_part(x.iri, ':', 1) AND a.key <> x.key WHERE x.iri LIKE 'k%' AND k < 20)
      SELECT doc_id, key, arg_max(iri, k) AS iri FROM x GROUP BY doc_id, key""",
    "c20_outside_host_list": f"{ctes('rules')} SELECT doc_id, path, assigner FROM rules WHERE assigner IS NOT NULL AND assigner NOT IN (SELECT 'urn:party:s' || s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)",
    "c21_outside_closed_terms": f"{BASE} SELECT doc_id, path, iri FROM expanded WHERE slot = 'action' AND iri NOT IN (SELECT iri FROM odrl_terms WHERE core)",
    "c22_overlay_orphans": f"{ctes('hints', 'terms')} SELECT left_iri, closed FROM hints WHERE left_iri NOT IN (SELECT iri FROM terms WHERE kind = 'LeftOperand')",
    "v5_layer_hints": f"""{ctes("hints")}, patch AS ({PATCH.format(part="part")}) SELECT coalesce(h.left_iri, p.left_iri) AS left_iri, coalesce(p.datatype, h.datatype) AS datatype, coalesce(p.pattern, h.pattern) AS pattern,
      CASE WHEN p.datatype IS NOT NULL THEN 'overlay' WHEN h.datatype IS NOT NULL THEN 'base' END AS src_datatype, CASE WHEN p.pattern IS NOT NULL THEN 'overlay' WHEN h.pattern IS NOT NULL THEN 'base' END AS src_pattern
      FROM hints h FULL JOIN patch p ON p.left_iri = h.left_iri""",
    "v5_four_layers": _layers_sql(),
    "e10_filter_suggestions": """WITH o AS (SELECT p_partkey AS ix, p_type || ' ' || p_brand AS label, p_name AS hint, p_brand AS grp FROM part),
      h AS (SELECT *, CASE WHEN lower(label) LIKE 'ar%' THEN 0 WHEN lower(label) LIKE '%ar%' THEN 1 WHEN lower(hint) LIKE '%ar%' THEN 2 END AS rank FROM o), g AS (SELECT *, min(rank * 1000000000 + ix) OVER (PARTITION BY grp) AS pos FROM h WHERE rank IS NOT NULL)
      SELECT ix, label, grp, rank FROM g ORDER BY pos, rank, ix LIMIT 500""",
    "e9_first_declaration": f"""{ctes("rules")} SELECT doc_id, target AS iri, policy_ix, rule_ix FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target ORDER BY policy_ix, rule_ix) AS rn FROM rules WHERE target IS NOT NULL) WHERE rn = 1""",
    "e7_dedupe_notes": f"""{TERM_FINDINGS}, o AS (SELECT doc_id, rule || ' ' || written AS note, min({order_sql('path')}) AS ord FROM tf GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, note) - 1 AS ix, count(*) OVER (PARTITION BY doc_id) AS n FROM o)
      SELECT doc_id, ix, note, 0 AS n_more FROM r""",
    "p9_inherited_rules": f"""{M}, r AS (SELECT w.doc_id, w.policy_ix, w.ancestor_ix AS from_ix, path, row_number() OVER (PARTITION BY w.doc_id, w.policy_ix ORDER BY w.ix, rule_ix) - 1 AS ix
      FROM walk w JOIN rules r ON r.doc_id = w.doc_id AND r.policy_ix = w.ancestor_ix) SELECT doc_id, policy_ix, ix, from_ix, path FROM r WHERE ix < 5000""",
    "r4_fixes": f"""{FOUND}, tf AS (SELECT DISTINCT doc_id, path, slot, rule, written FROM judged WHERE rule IN ('profile.unbound-prefix', 'profile.not-declared')), met AS (SELECT DISTINCT tf.*, e.iri FROM tf JOIN expanded e USING (doc_id, path, slot, written))
      SELECT doc_id, path, rule, slot, 'Write the full IRI' AS label, iri AS replacement, true AS safe FROM met WHERE rule = 'profile.unbound-prefix'
      UNION ALL SELECT doc_id, path, rule, slot, 'Declare the profile <' || p.iri || '>', p.iri, true FROM met JOIN firsts f ON f.iri = met.iri JOIN profiles p ON p.profile_id = f.profile_id WHERE rule = 'profile.not-declared'
      UNION ALL SELECT h.doc_id, h.path, h.rule, 'value', 'Write it as an IRI', raw, true FROM (SELECT DISTINCT doc_id, path, rule FROM hinted WHERE rule = 'prose.iri-expected') h JOIN constraints c ON c.doc_id = h.doc_id AND c.path = h.path
      UNION ALL SELECT doc_id, owner || '.action[' || ix || ']', 'heuristic.duplicate-action', 'action', 'Remove the duplicate', '', true FROM ({DUPLICATE}) WHERE removable
      UNION ALL SELECT doc_id, path, rule, 'group', 'Ungroup', '', true FROM ({HEURISTIC}) WHERE rule = 'heuristic.single-child-group'""",
    "r5_apply_safe_fixes": f"""{TERM_FINDINGS}, fixed AS (SELECT e.slot, CASE WHEN t.doc_id IS NOT NULL THEN e.iri ELSE e.written END AS written FROM expanded e
      LEFT JOIN (SELECT DISTINCT doc_id, path, slot, written FROM tf WHERE rule = 'profile.unbound-prefix') t USING (doc_id, path, slot, written)) SELECT slot, written, count(*) AS n FROM fixed GROUP BY ALL""",
    "r6_admissible": f"""{TERM_FINDINGS}, a AS (SELECT doc_id, path, slot, written, min(rule) AS rule FROM tf WHERE rule IN ('profile.undeclared-in-namespace', 'profile.unknown-term', 'profile.wrong-kind', 'profile.conflict-term', 'profile.unbound-prefix') GROUP BY doc_id, path, slot, written)
      SELECT u.doc_id, u.path, u.slot, u.written, a.rule, a.rule IS NULL AS ok FROM uses u LEFT JOIN a ON a.doc_id = u.doc_id AND a.path = u.path AND a.slot = u.slot AND a.written = u.written""",
    "b4_prefix_is_odrl": "SELECT o_custkey AS doc_id, coalesce(bool_and(o_orderkey % 10 <> 0) FILTER (o_orderkey % 2 = 0), true) AS ok FROM orders GROUP BY o_custkey",
    "v2_profile_terms": f"""{T} SELECT graph_id, s AS iri, min(o_iri) FILTER (p = 'rdf:type') AS kind, count(o_value) FILTER (p = 'rdfs:label') AS n_labels,
      coalesce(string_agg(DISTINCT o_iri, ',' ORDER BY o_iri) FILTER (p = 'skos:broader'), '') AS broader, false AS deprecated FROM triples GROUP BY graph_id, s""",
    "g9_class_members": f"""{T}, cls AS (SELECT DISTINCT parent AS cls FROM edges WHERE parent LIKE 'urn:kind:%') SELECT cls, cls AS iri FROM cls UNION SELECT cls, s FROM cls JOIN triples ON p = 'rdf:type' AND o_iri = cls
      UNION SELECT cls, child FROM cls JOIN edges ON parent = cls WHERE child NOT LIKE 'urn:part:%'""",
    "g8_hierarchy_cycles": f"{ctes('links')}, w AS (SELECT child AS a, parent AS b FROM links UNION SELECT w.a, l.parent FROM w JOIN links l ON l.child = w.b) SELECT a AS iri FROM w WHERE a = b",
    "h13_when_text": f"""{ctes("lines")}, s AS ({STAMPS.format(lines="lines")}) SELECT stamp, CASE WHEN stamp LIKE 'x %' THEN 'at "' || stamp || '"' WHEN stamp LIKE '%T1030' THEN 'at ' || stamp WHEN stamp LIKE '%Z' THEN 'on ' || substr(stamp, 1, 10) || ' at 10:00 UTC'
      WHEN stamp LIKE '%+02:00' THEN 'on ' || substr(stamp, 1, 10) || ' at 10:30 UTC+02:00' WHEN stamp LIKE '%.5' THEN 'on ' || substr(stamp, 1, 10) || ' at 10:30:15.5' ELSE 'on ' || stamp END AS told FROM s""",
    "h21_resolve_iri": """WITH b AS (SELECT page_id, split_part(url, '#', 1) AS f, split_part(split_part(url, '#', 1), '?', 1) AS q FROM pages)
      SELECT page_id, f || '#x' AS fragment, q || '?q=1' AS query, split_part(q, ':', 1) || '://h/x' AS host, regexp_extract(q, '^[^:]*://[^/]*') || '/x' AS root,
        CASE WHEN regexp_matches(q, '^[^:]*://[^/]+/') THEN regexp_extract(q, '^(.*/)[^/]*$', 1) || 'x' ELSE q || '/x' END AS beside FROM b""",
    "h23_slugs": """SELECT page_id, lower(regexp_replace(CASE WHEN len(p) > 2 THEN p[-2] || '-' || p[-1] ELSE array_to_string(p, '-') END, '[^A-Za-z0-9]', '-', 'g')) AS slug, 'One two ' || page_id AS title, trim(regexp_replace('a / b ' || replace(url, '|', '/'), '\\s+', ' ', 'g')) AS cell
      FROM (SELECT page_id, url, list_filter(string_split(url || '/examples/A b', '/'), lambda x: x NOT IN ('resources', 'src', 'main', 'example', 'examples')) AS p FROM pages)""",
    "h17_labels": """WITH l AS (SELECT DISTINCT p_type AS t, p_brand AS b FROM part) SELECT upper(t[1]) || lower(t[2:]) || ' ' || b AS label, lower(t) || ' ' || lower(b) AS inside, 'the ' || lower(t) || ' ' || lower(b) AS told FROM l""",
}
# The same with the reference's numbers: no cap on a document's notes, 5000 inherited rules.
ORACLES["e7_dedupe_notes_full"] = ORACLES["e7_dedupe_notes"]
ORACLES["p9_inherited_rules_full"] = ORACLES["p9_inherited_rules"]
