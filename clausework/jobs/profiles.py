"""Queries over profiles, shapes and texts, with vocabularies derived from suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.corpus import Corpus, ctes
from clausework.functions import texts
from clausework.model import ODRL
from clausework.operators import jsonld, profiles, rewrite, vocabulary
from clausework.sources import flatten

# A graph for each supplier: its header; parts are the terms, dealt over a hundred graphs. Both engines read this text.
PROFILE_TRIPLES = """
SELECT concat('g', cast(s_suppkey AS string)) AS graph_id, s_suppkey * 10 AS seq, CASE WHEN s_suppkey % 4 = 0 THEN concat('_:b', cast(s_suppkey AS string)) ELSE concat('urn:profile:', cast(s_suppkey AS string)) END AS s,
  'rdf:type' AS p, CASE s_suppkey % 3 WHEN 0 THEN 'owl:Ontology' WHEN 1 THEN 'prof:Profile' ELSE 'odrl:Profile' END AS o_iri, cast(NULL AS string) AS o_value, cast(NULL AS string) AS o_lang FROM {supplier} WHERE s_suppkey % 5 <> 4
UNION ALL SELECT concat('g', cast(s_suppkey AS string)), s_suppkey * 10 + k, CASE WHEN s_suppkey % 4 = 0 THEN concat('_:b', cast(s_suppkey AS string)) ELSE concat('urn:profile:', cast(s_suppkey AS string)) END,
  CASE k WHEN 1 THEN 'rdfs:label' WHEN 2 THEN 'dct:title' WHEN 3 THEN 'owl:versionInfo' WHEN 4 THEN 'owl:imports' WHEN 5 THEN 'prof:isProfileOf' WHEN 6 THEN 'dct:license' ELSE 'ex:internal' END,
  CASE k WHEN 4 THEN concat('urn:base:', cast(s_nationkey AS string)) WHEN 5 THEN 'urn:core' WHEN 6 THEN 'urn:licence' END,
  CASE k WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN concat('<b>', s_name, '</b> &amp; co') ELSE ' <i></i> ' END WHEN 2 THEN s_name WHEN 3 THEN concat('1.', cast(s_nationkey AS string)) WHEN 7 THEN s_name END, CASE WHEN k < 3 THEN 'en' END
  FROM (SELECT *, explode_k AS k FROM ks)
UNION ALL SELECT concat('g', cast(p_partkey % 100 AS string)), 1000000 + p_partkey * 10, concat('urn:part:', cast(p_partkey AS string)), 'rdf:type',
  CASE p_size % 4 WHEN 0 THEN 'odrl:Action' WHEN 1 THEN 'odrl:LeftOperand' WHEN 2 THEN 'odrl:Operator' ELSE 'skos:Concept' END, NULL, NULL FROM {part}
UNION ALL SELECT concat('g', cast(p_partkey % 100 AS string)), 1000000 + p_partkey * 10 + 1, concat('urn:part:', cast(p_partkey AS string)), 'rdfs:label', NULL, p_name, 'en' FROM {part}
UNION ALL SELECT concat('g', cast(p_partkey % 100 AS string)), 1000000 + p_partkey * 10 + 2, concat('urn:part:', cast(p_partkey AS string)), 'rdfs:isDefinedBy', concat('urn:defined:', p_brand), NULL, NULL FROM {part}
UNION ALL SELECT concat('g', cast(p_partkey % 100 AS string)), 1000000 + p_partkey * 10 + 3, concat('urn:part:', cast(p_partkey AS string)), 'ex:internal', NULL, p_name, NULL FROM {part}
"""
KS = "SELECT s.*, k AS explode_k FROM {supplier} s JOIN (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6), (7)) AS v(k)) ks ON s_suppkey % 5 <> 4 AND (k <> 6 OR s_suppkey % 2 = 0)"
# Shapes of parts: properties, groups and lists below each other, some negated, some switched off.
SHAPE_TRIPLES = """
SELECT concat('g', cast(p_size AS string)) AS graph_id, concat('urn:shape:', cast(p_partkey AS string)) AS s, 'sh:property' AS p, concat('urn:prop:', cast(p_partkey AS string)) AS o_iri, cast(NULL AS string) AS o_value FROM {part}
UNION ALL SELECT concat('g', cast(p_size AS string)), concat('urn:shape:', cast(p_partkey AS string)), CASE WHEN p_partkey % 14 = 0 THEN 'sh:not' ELSE 'sh:xone' END, concat('urn:group:', p_brand), NULL FROM {part} WHERE p_partkey % 7 = 0
UNION ALL SELECT concat('g', cast(p_size AS string)), concat('urn:group:', p_brand), 'rdf:first', concat('urn:shape:', cast(p_partkey AS string)), NULL FROM {part} WHERE p_partkey % 3 = 0
UNION ALL SELECT concat('g', cast(p_size AS string)), concat('urn:prop:', cast(p_partkey AS string)), 'sh:in', concat('urn:list:', p_type), NULL FROM {part}
UNION ALL SELECT concat('g', cast(p_size AS string)), concat('urn:prop:', cast(p_partkey AS string)), 'ex:see', concat('urn:other:', p_type), NULL FROM {part}
UNION ALL SELECT concat('g', cast(p_size AS string)), concat('urn:shape:', cast(p_partkey AS string)), 'sh:deactivated', NULL, CASE WHEN p_partkey % 2 = 0 THEN ' true ' ELSE 'false' END FROM {part} WHERE p_partkey % 11 = 0
"""
NOTES = f"""
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'odrl:summary' WHEN 2 THEN '{ODRL}timestamp' WHEN 3 THEN 'https://w3id.org/dspace/2024/1/summary' WHEN 4 THEN 'dspace:timestamp' WHEN 5 THEN 'summary' ELSE 'ex:summary' END AS key,
  o_orderstatus = 'F' AS agreement, CASE WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 7 IN (0, 2, 4) THEN concat(' ', substring(cast(o_orderdate AS string), 1, 10)) WHEN o_orderkey % 2 = 0 THEN concat(o_orderpriority, '!') ELSE o_orderpriority END AS value,
  CASE WHEN o_orderkey % 3 = 0 THEN 'en' END AS lang FROM {{orders}}
"""
LABELS = """
SELECT concat('urn:part:', cast(p_partkey AS string)) AS s, 'rdfs:label' AS p, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE concat(' ', p_name) END AS text,
  CASE p_partkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'en-GB' WHEN 4 THEN 'fr-CH' END AS lang, 0 AS ix FROM {part}
UNION ALL SELECT concat('urn:part:', cast(p_partkey AS string)), 'rdfs:label', concat('U ', p_name), NULL, 1 FROM {part} WHERE p_partkey % 3 = 0 AND p_partkey % 13 <> 0
UNION ALL SELECT concat('urn:part:', cast(p_partkey AS string)), 'dct:title', p_brand, 'fr', 2 FROM {part}
"""
# A document for each customer's orders: contexts by reference, by import, in a graph, and further down.
CONTEXT_DOCS = """
SELECT o_orderkey AS doc_id, concat('{{"@context": ["http://www.w3.org/ns/odrl.jsonld/", "https://example.org/c', cast(o_custkey % 9 AS string), '"], "@graph": [{{"@context": {{"@import": "https://example.org/i',
  cast(o_custkey % 4 AS string), '", "@context": 1}}, "uid": "urn:x", "permission": [{{"action": {{"@value": {{"@context": "data"}}}}', CASE WHEN o_orderkey % 5 = 0 THEN ', "@context": "https://example.org/below"' ELSE '' END, '}}]}}]}}') AS text FROM {orders}
"""

# A document for each order: keys through prefixes of prefixes, other terms, the vocabulary, JSON data and a circle of terms.
KEY_DOCS = f"""
SELECT o_orderkey AS doc_id, concat('{{{{"@context": {{{{"o": "odrl:", "p', cast(o_custkey % 5 AS string), '": "o:", "may": "o:permission", "permission": "odrl:permission", "ex": "https://example.org/", "raw": {{{{"@id": "ex:raw", "@type": "@json"}}}}',
  CASE WHEN o_orderkey % 4 = 0 THEN ', "@vocab": "{ODRL}"' ELSE '' END, CASE WHEN o_orderkey % 6 = 0 THEN ', "tick": "tock", "tock": "tick"' ELSE '' END, '}}}}, "p2:target": "urn:t", "ex:note": 1, "_:x": 2, "permission": [{{{{"may": 1, "odrl:action": "use"}}}}], "raw": [{{{{"odrl:unit": 1}}}}], "tick": {{{{"@value": {{{{"odrl:duty": 1}}}}}}}}',
  CASE WHEN o_orderkey % 3 = 0 THEN ', "{ODRL}uid": "urn:u", "extra": 1' ELSE '' END, '}}}}') AS text FROM {{orders}}
"""

# A profile for each part: a term with labels in two languages, a list of broader terms, a nested node, and what is not followed.
PROFILE_DOCS = """
SELECT p_partkey AS doc_id, concat('{{"@context": [', CASE WHEN p_partkey % 9 = 0 THEN '"https://example.org/remote", ' ELSE '' END, '"http://www.w3.org/ns/odrl.jsonld", {{"ex": "urn:ex:", "br": "ex:brand/", "label": "rdfs:label", "up": {{"@id": "skos:broader", "@type": "@id"}}, "@language": "en"}}], "@graph": [{{"@id": "ex:t',
  cast(p_partkey AS string), '", "@type": "', CASE WHEN p_size % 2 = 0 THEN 'Action' ELSE 'odrl:LeftOperand' END, '", "label": ["', p_name, '", {{"@value": "', p_type, '", "@language": "de"}}], "up": {{"@list": ["br:', cast(p_size AS string), '", "ex:all"]}}, "ex:size": ',
  cast(p_size AS string), ', "ex:part": {{"label": "', p_type, '"}}', CASE WHEN p_partkey % 4 = 0 THEN ', "owl:deprecated": true' ELSE '' END, '}}]}}') AS text FROM {part}
"""

# The same event written in two ways.
SPELLED = """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('{{"type": "', event_type, '", "of": [{{"user": ', cast(user_id AS string), ', "id": null}}, 5.0]}}')
  ELSE concat('{{"of":[{{"id":null,"user":', cast(user_id AS string), '}},5],  "type":"', event_type, '"}}', CASE WHEN event_id % 5 = 0 THEN '}}' ELSE '' END) END AS text FROM {events}
"""


def _profile_docs(c: Corpus) -> tuple[DataFrame, DataFrame]:
    return jsonld.profile_triples(flatten.flatten(c.spark.sql(PROFILE_DOCS, part=c.part.repartition("p_partkey"))))  # a short file is a task or two


def _triples(c: Corpus) -> DataFrame:
    ks = c.spark.sql(KS, supplier=c.supplier)
    return c.spark.sql(PROFILE_TRIPLES.replace("FROM ks)", "FROM {ks})"), supplier=c.supplier, part=c.part, ks=ks)


def _items(c: Corpus) -> DataFrame:
    return c.part.select(F.col("p_brand").alias("left_iri"), F.col("p_type").alias("facet"), F.col("p_name").alias("value"), (F.col("p_partkey") % 5).alias("shape_ix"), F.col("p_partkey").alias("ix"), "p_size")


def _picker(c: Corpus) -> DataFrame:
    iri = F.concat(F.lit("urn:part:"), F.col("p_partkey").cast("string"))
    nodes = c.part.select(iri.alias("iri"), F.array("p_type", "p_brand", iri).alias("path"))
    terms = c.part.select(iri.alias("iri"), F.col("p_name").alias("label"), (F.col("p_size") % 9 == 0).alias("deprecated"))
    builtins = c.part.where("p_partkey % 10 = 0").select(iri.alias("iri"), F.upper("p_name").alias("label"))
    return profiles.picker_order(nodes, terms, builtins).select("iri", "label", "grp", F.array_join("path", "/").alias("path"))


def _notes(c: Corpus) -> DataFrame:
    term = texts.metadata_term(F.col("key"))
    note = texts.metadata_note(term, F.col("agreement"), F.col("value"), F.col("lang"))
    return c.spark.sql(NOTES, orders=c.orders).select("o_orderkey", term.alias("term"), note.alias("note"))


QUERIES = {
    "v1_profile_headers": lambda c: profiles.profile_headers(_triples(c), ["en"]).withColumn("imports", F.array_join("imports", ",")),
    "a9_trim_vocabulary": lambda c: profiles.trim_vocabulary(_triples(c)),
    "g11_skipped_shapes": lambda c: profiles.skipped_shapes(c.spark.sql(SHAPE_TRIPLES, part=c.part)),
    "d16_union_facets": lambda c: profiles.union_facets(_items(c)),
    "u4_same_shapes": lambda c: profiles.same_shapes(_items(c), _items(c).where("ix % 2 = 0")),
    "u5_widened_values": lambda c: profiles.widened_values(_items(c).where("p_size % 2 = 0"), _items(c).where("p_size % 7 = 0 and left_iri <> 'Brand#2'")),
    "f2_picker_order": _picker,
    "e4_node_labels": lambda c: vocabulary.node_label(c.spark.sql(LABELS, part=c.part), ["s"], ["fr"]),
    "b8_unread_contexts": lambda c: rewrite.unread_contexts(flatten.flatten(c.spark.sql(CONTEXT_DOCS, orders=c.orders.repartition("o_orderkey")), "doc_id", "path", "parent", "key", "kind", "value")),
    "a6_profile_triples": lambda c: _profile_docs(c)[0].drop("seq"),
    "a6_profile_notes": lambda c: _profile_docs(c)[1],
    "b7_unread_keys": lambda c: rewrite.unread_keys(flatten.flatten(c.spark.sql(KEY_DOCS, orders=c.orders))),
    "f3_canonical_json": lambda c: c.spark.sql(SPELLED, events=c.events).select("event_id", texts.canonical_json(F.col("text")).alias("text")),
    "h14_metadata_notes": _notes,
    "h16_plain_text": lambda c: c.pages.select("page_id", texts.plain(F.col("html")).alias("text"), texts.plain(F.col("html"), profiles.LABEL_CHARS).alias("label")),
    "h24_safe_text": lambda c: c.documents.select("doc_id", texts.safe_text(F.col("text")).alias("shown")),
    "h28_policy_types": lambda c: c.policies.select(
        "doc_id", "policy_ix", texts.policy_type_iri(F.coalesce("kind", F.lit("")), F.concat(F.lit(ODRL), F.coalesce(F.when(F.col("policy_ix") % 9 == 0, "Policy"), "kind"))).alias("iri")
    ),
}

P = f"WITH ks AS ({KS.format(supplier='supplier')}), triples AS ({PROFILE_TRIPLES.format(supplier='supplier', part='part')})"
ITEMS = "WITH items AS (SELECT p_brand AS left_iri, p_type AS facet, p_name AS value, p_partkey % 5 AS shape_ix, p_partkey AS ix, p_size FROM part)"
PLAIN = r"""regexp_replace(html, '<[A-Za-z/!?][^>]*(>|$)', ' ', 'g')"""
_CODE = "CASE WHEN lower(x[3]) = 'x' THEN CAST('0x' || ltrim(x[4:len(x) - 1], '+') AS BIGINT) ELSE CAST(ltrim(x[3:len(x) - 1], '+') AS BIGINT) END"
ORACLES = {
    "v1_profile_headers": f"""{P}, graphs AS (SELECT DISTINCT graph_id FROM triples),
      heads AS (SELECT graph_id, arg_min(s, seq) AS s FROM triples WHERE p = 'rdf:type' AND o_iri IN ('owl:Ontology', 'prof:Profile', 'odrl:Profile') GROUP BY graph_id),
      said AS (SELECT graph_id, o_iri, count(*) AS n, min(seq) AS pos FROM triples WHERE p = 'rdfs:isDefinedBy' GROUP BY ALL),
      most AS (SELECT graph_id, o_iri AS maker FROM said QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, pos) = 1),
      h AS (SELECT graph_id, CASE WHEN s LIKE '_:%' AND s[1] = '_' OR s IS NULL THEN maker ELSE s END AS iri, coalesce(s, maker) AS s FROM graphs LEFT JOIN heads USING (graph_id) LEFT JOIN most USING (graph_id))
      SELECT h.graph_id, iri, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ' & co' ELSE s_name END AS title, CAST(NULL AS VARCHAR) AS description, '1.' || s_nationkey AS version,
        CASE WHEN s_suppkey IS NULL THEN '' ELSE 'urn:base:' || s_nationkey || ',urn:core' END AS imports FROM h LEFT JOIN supplier ON h.graph_id = 'g' || s_suppkey AND s_suppkey % 5 <> 4""",
    "a9_trim_vocabulary": f"""{P}, ont AS (SELECT graph_id, s FROM triples WHERE p = 'rdf:type' AND o_iri = 'owl:Ontology'), lic AS (SELECT DISTINCT graph_id FROM triples SEMI JOIN ont USING (graph_id, s) WHERE p = 'dct:license'),
      term AS (SELECT DISTINCT graph_id, s FROM triples WHERE p = 'rdf:type' AND o_iri IN ('odrl:Action', 'odrl:LeftOperand', 'odrl:Operator'))
      SELECT t.* FROM triples t SEMI JOIN lic USING (graph_id) WHERE ((graph_id, s) IN (SELECT (graph_id, s) FROM term) AND p IN ('rdf:type', 'rdfs:label')) OR ((graph_id, s) IN (SELECT (graph_id, s) FROM ont) AND p IN ('rdf:type', 'rdfs:label', 'owl:versionInfo', 'dct:license'))""",
    "g11_skipped_shapes": f"""WITH RECURSIVE t AS ({SHAPE_TRIPLES.format(part="part")}), k AS (SELECT graph_id, o_iri AS s FROM t WHERE p IN ('sh:not', 'sh:xone')
      UNION SELECT t.graph_id, t.o_iri FROM k JOIN t USING (graph_id, s) WHERE t.o_iri IS NOT NULL AND (t.p LIKE 'sh:%' OR t.p = 'rdf:first'))
      SELECT * FROM k UNION SELECT graph_id, s FROM t WHERE p = 'sh:deactivated' AND trim(o_value) = 'true'""",
    "d16_union_facets": f"""{ITEMS}, f AS (SELECT left_iri, facet, value, min((shape_ix, ix)) AS pos FROM items GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY left_iri, facet ORDER BY pos) - 1 AS ix, count(*) OVER (PARTITION BY left_iri, facet) AS n FROM f)
      SELECT left_iri, facet, ix, value, greatest(n - 256, 0) AS n_more FROM r WHERE ix < 256""",
    "u4_same_shapes": f"{ITEMS} SELECT 'a' AS only_in, * FROM (SELECT left_iri, facet, value FROM items EXCEPT SELECT left_iri, facet, value FROM items WHERE ix % 2 = 0)",
    "u5_widened_values": f"""{ITEMS}, b AS (SELECT left_iri, value FROM items WHERE p_size % 7 = 0 AND left_iri <> 'Brand#2') SELECT left_iri, value FROM items WHERE p_size % 2 = 0 AND left_iri IN (SELECT left_iri FROM b) EXCEPT SELECT * FROM b""",
    "f2_picker_order": """SELECT 'urn:part:' || p_partkey AS iri, CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE p_name END AS label, (p_partkey % 10 <> 0)::INT AS grp,
      CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_type || '/' || p_brand || '/' END || 'urn:part:' || p_partkey AS path FROM part WHERE p_partkey % 10 = 0 OR p_size % 9 <> 0""",
    "e4_node_labels": """SELECT 'urn:part:' || p_partkey AS s, CASE WHEN p_partkey % 5 IN (3, 4) OR p_partkey % 3 <> 0 THEN p_name ELSE 'U ' || p_name END AS label FROM part WHERE p_partkey % 13 <> 0""",
    "b8_unread_contexts": """SELECT o_orderkey AS doc_id, 'remote' AS form, 'https://example.org/c' || o_custkey % 9 AS iri FROM orders UNION SELECT o_orderkey, 'remote', 'https://example.org/i' || o_custkey % 4 FROM orders
      UNION SELECT o_orderkey, 'nested', NULL FROM orders WHERE o_orderkey % 5 = 0""",
    "a6_profile_triples": """WITH t AS (SELECT p_partkey AS graph_id, 'urn:ex:t' || p_partkey AS s, * FROM part)
      SELECT graph_id, s, 'rdf:type' AS p, CASE WHEN p_size % 2 = 0 THEN 'odrl:Action' ELSE 'odrl:LeftOperand' END AS o_iri, NULL AS o_value, NULL AS o_lang FROM t
      UNION ALL SELECT graph_id, s, 'rdfs:label', NULL, unnest([p_name, p_type]), unnest(['en', 'de']) FROM t UNION ALL SELECT graph_id, s, 'skos:broader', unnest(['urn:ex:brand/' || p_size, 'urn:ex:all']), NULL, NULL FROM t
      UNION ALL SELECT graph_id, s, 'urn:ex:size', NULL, p_size::VARCHAR, NULL FROM t UNION ALL SELECT graph_id, s, 'urn:ex:part', '_:@graph[0].ex:part', NULL, NULL FROM t
      UNION ALL SELECT graph_id, '_:@graph[0].ex:part', 'rdfs:label', NULL, p_type, 'en' FROM t UNION ALL SELECT graph_id, s, 'owl:deprecated', NULL, 'true', NULL FROM t WHERE p_partkey % 4 = 0""",
    "a6_profile_notes": "SELECT p_partkey AS graph_id, 'context not fetched' AS note, 'https://example.org/remote' AS about FROM part WHERE p_partkey % 9 = 0",
    "b7_unread_keys": f"""SELECT o_orderkey AS doc_id, unnest(['may', 'odrl:action']) AS key FROM orders UNION ALL SELECT o_orderkey, 'p2:target' FROM orders WHERE o_custkey % 5 = 2
      UNION ALL SELECT o_orderkey, '{ODRL}uid' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'tick' FROM orders WHERE o_orderkey % 6 = 0""",
    "f3_canonical_json": """SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 5 <> 0 THEN '{"of":[{"id":null,"user":' || user_id || '},5],"type":"' || event_type || '"}' END AS text FROM events""",
    "h14_metadata_notes": f"""WITH n AS ({NOTES.format(orders="orders")}), t AS (SELECT *, CASE WHEN key = 'ex:summary' THEN NULL WHEN key LIKE '%timestamp' THEN 'timestamp' ELSE 'summary' END AS term, trim(value) AS v FROM n)
      SELECT o_orderkey, term, CASE WHEN v = '' OR term IS NULL THEN NULL WHEN term = 'timestamp' THEN CASE WHEN agreement THEN 'Agreed on ' ELSE 'Issued on ' END || v || '.'
        ELSE 'Summary' || CASE WHEN lang IS NULL THEN '' ELSE ' (' || lang || ')' END || ': ' || v || CASE WHEN v LIKE '%!' THEN '' ELSE '.' END END AS note FROM t""",
    "h16_plain_text": f"""WITH p AS (SELECT page_id, html, list_transform(regexp_extract_all({PLAIN}, '&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]{{1,9}}|#\\+[0-9]{{1,8}}|#[xX][0-9A-Fa-f]{{1,8}}|#[xX]\\+[0-9A-Fa-f]{{1,7}});|[^&]+|&'), lambda x:
        CASE WHEN x = '&amp;' THEN '&' WHEN x = '&lt;' THEN '<' WHEN x = '&gt;' THEN '>' WHEN x = '&quot;' THEN '"' WHEN x = '&apos;' THEN '''' WHEN x = '&nbsp;' THEN ' ' WHEN x[1:2] = '&#' AND len(x) > 2 AND x[-1] = ';' THEN chr(CAST({_CODE} AS INT)) ELSE x END) AS w FROM pages),
      q AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(array_to_string(w, ''), '[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x84\\x86-\\x9F\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]+', '', 'g'), '[\\x09-\\x0D \\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{3000}}]+', ' ', 'g')) AS t FROM p)
      SELECT page_id, CASE WHEN html IS NOT NULL THEN coalesce(t, '') END AS text, CASE WHEN html IS NULL THEN NULL WHEN length(coalesce(t, '')) <= 200 THEN coalesce(t, '') ELSE rtrim(t[1:199]) || '…' END AS label FROM q""",
    "h24_safe_text": r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\x00-\x1F\x7F-\x{9F}\x{61C}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2066}-\x{2069}]|[^\x00-\x1F\x7F-\x{9F}\x{61C}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2066}-\x{2069}]+'),
      lambda x: CASE WHEN x = chr(10) THEN '\n' WHEN x = chr(13) THEN '\r' WHEN x = chr(9) THEN '\t' WHEN regexp_matches(x, '^[\x00-\x1F\x7F-\x{9F}\x{61C}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2066}-\x{2069}]') THEN '\u{' || lower(printf('%x', unicode(x))) || '}' ELSE x END), '') AS shown FROM documents""",
    "h28_policy_types": f"{ctes('policies')} SELECT doc_id, policy_ix, CASE WHEN coalesce(kind, '') = '' OR policy_ix % 9 = 0 THEN '{ODRL}Set' ELSE '{ODRL}' || kind END AS iri FROM policies",
}
