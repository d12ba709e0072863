"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
         array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, p.i, p.n, item_id FROM pos p JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP4 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


#: Nodes of all trees by level; ``crc`` is the CRC-32 of the decimal doc_id, bit by bit.
OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS ix, count(*) OVER (PARTITION BY lang) AS n,
    sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR)) || ':' || (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS other
  FROM d),
node AS (
  SELECT lang, 0 AS level, ix, n, leaf AS h FROM leaf
  UNION ALL
  SELECT lang, any_value(level) + 1, ix // 2, CAST(ceil(any_value(n) / 2) AS BIGINT), sha256(string_agg(h, '' ORDER BY ix)) FROM node WHERE n > 1 GROUP BY lang, ix // 2),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS ix, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, ix, n, subroot AS h FROM sub
  UNION ALL
  SELECT any_value(level) + 1, ix // 2, CAST(ceil(any_value(n) / 2) AS BIGINT), sha256(string_agg(h, '' ORDER BY ix)) FROM top WHERE n > 1 GROUP BY ix // 2),
step AS (
  SELECT l.doc_id, x.level, x.ix % 2 AS slot, coalesce(y.h, '') AS sibling
  FROM leaf l JOIN node x ON x.lang IS NOT DISTINCT FROM l.lang AND x.ix = l.ix >> x.level AND x.n > 1
  LEFT JOIN node y ON y.lang IS NOT DISTINCT FROM x.lang AND y.level = x.level AND y.ix = xor(x.ix, 1)
  UNION ALL
  SELECT l.doc_id, 1000 + x.level, x.ix % 2, coalesce(y.h, '')
  FROM leaf l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang JOIN top x ON x.ix = s.ix >> x.level AND x.n > 1 LEFT JOIN top y ON y.level = x.level AND y.ix = xor(x.ix, 1)),
way AS (SELECT doc_id, list(struct_pack(slot, sibling) ORDER BY level) AS steps FROM step GROUP BY doc_id),
fold AS (
  SELECT l.doc_id, l.other AS h, coalesce(w.steps, []) AS steps, 1 AS p FROM leaf l LEFT JOIN way w USING (doc_id)
  UNION ALL
  SELECT doc_id, sha256(CASE WHEN steps[p].slot = 0 THEN h || steps[p].sibling ELSE steps[p].sibling || h END), steps, p + 1 FROM fold WHERE p <= len(steps)),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(array_to_string(list_transform(f.steps, lambda x: x.sibling), '')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM leaf l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang JOIN fold f ON f.doc_id = l.doc_id AND f.p = len(f.steps) + 1 CROSS JOIN root r
"""

# Shingles of three words, links from 85 in a hundred on.
OP12 = (
    OP4.replace("w[i : i + 4]", "w[i : i + 2]").replace("len(w) - 4", "len(w) - 2").replace(">= 80 *", ">= 85 *").replace("c.component_id FROM", "c.component_id, t.doc_id = c.component_id AS kept FROM")
)


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": OP4, "op8_decontamination": OP8, "op11_merkle": OP11, "op12_minhash": OP12}
