"""Queries over shapes and overlays, with graphs derived from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clausework.corpus import Corpus
from clausework.operators import shapes

_ROW = "SELECT concat('g', cast(p_partkey % 50 AS string)) AS graph_id, p_partkey * 100 + {at} AS seq, {s} AS s, '{p}' AS p, {iri} AS o_iri, {value} AS o_value FROM {{part}} WHERE {where}"
_N = "cast(p_partkey AS string)"


def _row(at: int, s: str, p: str, iri: str | None = None, value: str | None = None, where: str = "true") -> str:
    """A triple for each part that ``where`` keeps; ``urn:x:`` stands for a name with the part's number."""
    return _ROW.format(at=at, s=f"concat('{s}', {_N})", p=p, iri=iri or "cast(NULL AS string)", value=value or "cast(NULL AS string)", where=where)


def _named(prefix: str) -> str:
    return f"concat('{prefix}', {_N})"


# A constraint shape for each part: what it selects, its right operand (a list, a class, bounds or a pattern), its operators or units.
# Some are negated, some select two operands, some name what is no IRI; every fifth part closes the actions.
SHAPES = "\nUNION ALL ".join(
    [
        _row(0, "urn:shape:", "sh:property", _named("urn:sel:")),
        _row(1, "urn:shape:", "sh:property", _named("urn:right:")),
        _row(2, "urn:shape:", "sh:property", _named("urn:oper:")),
        _row(3, "urn:neg:", "sh:not", _named("urn:shape:"), where="p_partkey % 13 = 0"),
        _row(4, "urn:sel:", "sh:path", "'odrl:leftOperand'"),
        _row(5, "urn:sel:", "sh:hasValue", "concat('urn:left:', cast(p_size % 6 AS string))"),
        _row(6, "urn:sel:", "sh:hasValue", "'urn:left:other'", where="p_partkey % 17 = 0"),
        _row(7, "urn:right:", "sh:path", "'odrl:rightOperand'"),
        _row(8, "urn:right:", "sh:in", _named("urn:cell:"), where="p_partkey % 4 = 0"),
        _row(9, "urn:cell:", "rdf:first", "concat('urn:v:', cast(p_partkey % 30 AS string))", where="p_partkey % 4 = 0"),
        _row(10, "urn:cell:", "rdf:rest", _named("urn:last:"), where="p_partkey % 4 = 0"),
        _row(11, "urn:last:", "rdf:first", None, "concat('lit', cast(p_partkey % 5 AS string))", "p_partkey % 4 = 0"),
        _row(12, "urn:last:", "rdf:rest", "'rdf:nil'", where="p_partkey % 4 = 0"),
        _row(13, "urn:right:", "sh:class", "concat('urn:class:', p_type)", where="p_partkey % 4 = 1 OR p_partkey % 8 = 0"),
        _row(14, "urn:right:", "sh:datatype", "concat('xsd:', CASE WHEN p_partkey % 3 = 0 THEN 'date' ELSE 'integer' END)", where="p_partkey % 4 = 2"),
        _row(15, "urn:right:", "sh:minInclusive", None, "cast(p_partkey % 10 AS string)", "p_partkey % 4 = 2"),
        _row(16, "urn:right:", "sh:pattern", None, "concat('^', p_brand)", "p_partkey % 4 = 3"),
        _row(17, "urn:right:", "sh:flags", None, "CASE WHEN p_partkey % 3 = 0 THEN 'i' ELSE 'x' END", "p_partkey % 4 = 3 AND p_partkey % 3 <> 2"),
        _row(18, "urn:oper:", "sh:path", "CASE WHEN p_partkey % 2 = 0 THEN 'odrl:operator' ELSE 'odrl:unit' END"),
        _row(19, "urn:oper:", "sh:in", None, "CASE WHEN p_partkey % 11 = 0 THEN 'eq' ELSE concat('urn:op:', cast(p_partkey % 6 AS string)) END"),
        _row(20, "urn:oper:", "sh:in", "'urn:op:any'"),
        _row(21, "urn:act:", "sh:path", "'odrl:action'", where="p_partkey % 5 = 0"),
        _row(22, "urn:act:", "sh:in", "concat('urn:action:', cast(p_size AS string))", where="p_partkey % 5 = 0 AND p_partkey % 15 <> 0"),
        _row(23, "urn:act:", "sh:in", "'rdf:nil'", where="p_partkey % 15 = 0"),
        _row(24, "urn:act:", "sh:deactivated", None, "'true'", "p_partkey % 10 = 0"),
    ]
)
# Annotations of a part's term from several overlays, with what an overlay may not say.
OVERLAYS = "\nUNION ALL ".join(
    [
        _row(0, "urn:term:", "prose:rightOperand", "concat('urn:v:', p_brand)", where="p_partkey % 3 = 0"),
        _row(1, "urn:term:", "prose:rightOperand", "concat('urn:v:', p_type)", where="p_partkey % 3 = 0"),
        _row(2, "urn:term:", "prose:rightOperand", "concat('urn:v:', p_brand)", where="p_partkey % 6 = 0"),
        _row(3, "urn:term:", "prose:operator", "'odrl:eq'", where="p_partkey % 2 = 0"),
        _row(4, "urn:term:", "prose:datatype", "'xsd:date'", where="p_partkey % 4 = 0"),
        _row(5, "urn:term:", "prose:datatype", "'xsd:integer'", where="p_partkey % 5 <> 4"),
        _row(6, "urn:term:", "prose:closed", None, "CASE WHEN p_partkey % 2 = 0 THEN ' true' ELSE 'yes' END"),
        _row(7, "urn:term:", "prose:plural", None, "'1'", "p_partkey % 7 = 0"),
        _row(8, "urn:term:", "rdfs:label", None, "p_name", "p_partkey % 9 = 0"),
        _row(9, "urn:term:", "rdf:type", "'odrl:LeftOperand'", where="p_partkey % 8 = 0"),
        _row(10, "urn:term:", "prose:colour", None, "'red'", "p_partkey % 25 = 0"),
        _row(11, "_:b", "prose:unit", "'urn:unit'"),
    ]
)


def _shapes(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    return shapes.read_shapes(c.spark.sql(SHAPES, part=c.part))


def _overlay(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    return shapes.read_overlay(c.spark.sql(OVERLAYS, part=c.part))


QUERIES = {
    "v4_shape_lists": lambda c: _shapes(c)[0],
    "v4_shape_checks": lambda c: _shapes(c)[1],
    "v4_shape_notes": lambda c: _shapes(c)[2],
    "v3_overlay_lists": lambda c: _overlay(c)[0],
    "v3_overlay_facts": lambda c: _overlay(c)[1],
    "v3_overlay_notes": lambda c: _overlay(c)[2],
}

# The check reads the parts, not the triples: what a shape says follows from its part's number.
LIVE = """WITH live AS (SELECT p_partkey AS k, 'g' || p_partkey % 50 AS graph_id, 'urn:left:' || p_size % 6 AS left_iri, p_brand, p_type, p_size FROM part WHERE p_partkey % 13 <> 0),
  one AS (SELECT * FROM live WHERE k % 17 <> 0)"""
TERMS = "WITH t AS (SELECT p_partkey AS k, 'g' || p_partkey % 50 AS graph_id, 'urn:term:' || p_partkey AS left_iri, p_brand, p_type FROM part)"
RANKED = """SELECT graph_id, left_iri, facet, value, row_number() OVER (PARTITION BY graph_id, left_iri, facet ORDER BY pos) - 1 AS ix {0}
  FROM (SELECT graph_id, left_iri, facet, value, min(pos) AS pos FROM said GROUP BY ALL)"""
ORACLES = {
    "v4_shape_lists": f"""{LIVE}, said AS (SELECT graph_id, left_iri, 'values' AS facet, 'urn:v:' || k % 30 AS value, k * 2 AS pos FROM one WHERE k % 4 = 0
      UNION ALL SELECT graph_id, left_iri, 'literals', 'lit' || k % 5, k * 2 FROM one WHERE k % 4 = 0
      UNION ALL SELECT graph_id, left_iri, 'classes', 'urn:class:' || p_type, k * 2 FROM one WHERE k % 4 = 1
      UNION ALL SELECT graph_id, left_iri, CASE k % 2 WHEN 0 THEN 'operators' ELSE 'units' END, unnest(['urn:op:any', 'urn:op:' || k % 6]), unnest([k * 2, k * 2 + 1]) FROM one WHERE k % 11 <> 0
      UNION ALL SELECT 'g' || p_partkey % 50, '', 'actions', 'urn:action:' || p_size, p_partkey FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 10 <> 0 AND p_partkey % 15 <> 0)
      {RANKED.format(", 0 AS n_more")}""",
    "v4_shape_checks": f"""{LIVE}, r AS (SELECT graph_id, left_iri, k, CASE WHEN k % 4 = 2 THEN 'xsd:' || CASE WHEN k % 3 = 0 THEN 'date' ELSE 'integer' END END AS datatype, CASE WHEN k % 4 = 2 THEN (k % 10)::VARCHAR END AS low,
        CASE WHEN k % 4 = 3 AND k % 3 <> 1 THEN '^' || p_brand END AS pattern, CASE WHEN k % 4 = 3 AND k % 3 = 0 THEN 'i' WHEN k % 4 = 3 AND k % 3 = 2 THEN '' END AS flags FROM one)
      SELECT graph_id, left_iri, arg_min(datatype, k) FILTER (datatype IS NOT NULL) AS datatype, arg_min(pattern, k) FILTER (pattern IS NOT NULL) AS pattern, arg_min(flags, k) FILTER (pattern IS NOT NULL) AS flags,
        arg_min(low, k) FILTER (low IS NOT NULL) AS min_inclusive, CAST(NULL AS VARCHAR) AS max_inclusive FROM r GROUP BY ALL HAVING count(datatype) + count(pattern) > 0""",
    "v4_shape_notes": f"""{LIVE} SELECT graph_id, 'several left operands' AS note, 'urn:shape:' || k AS about FROM live WHERE k % 17 = 0
      UNION ALL SELECT graph_id, 'no left operand', unnest(['urn:right:' || k, 'urn:oper:' || k]) FROM live WHERE k % 17 = 0
      UNION ALL SELECT graph_id, 'list with a string that is no IRI', 'urn:oper:' || k FROM one WHERE k % 11 = 0
      UNION ALL SELECT 'g' || p_partkey % 50, 'empty list', 'urn:act:' || p_partkey FROM part WHERE p_partkey % 15 = 0 AND p_partkey % 10 <> 0
      UNION ALL SELECT graph_id, 'class beside a list', 'urn:right:' || k FROM one WHERE k % 8 = 0
      UNION ALL SELECT graph_id, 'pattern not read', 'urn:right:' || k FROM one WHERE k % 4 = 3 AND k % 3 = 1
      UNION ALL SELECT graph_id, 'second datatype', left_iri FROM one WHERE k % 4 = 2 GROUP BY ALL HAVING count(DISTINCT k % 3 = 0) > 1
      UNION ALL SELECT graph_id, 'second min_inclusive', left_iri FROM one WHERE k % 4 = 2 GROUP BY ALL HAVING count(DISTINCT k % 10) > 1
      UNION ALL SELECT graph_id, 'second pattern', left_iri FROM one WHERE k % 4 = 3 AND k % 3 <> 1 GROUP BY ALL HAVING count(DISTINCT (p_brand, k % 3)) > 1""",
    "v3_overlay_lists": f"""{TERMS}, said AS (SELECT graph_id, left_iri, 'values' AS facet, unnest(['urn:v:' || p_brand, 'urn:v:' || p_type]) AS value, unnest([1, 2]) AS pos FROM t WHERE k % 3 = 0
      UNION ALL SELECT graph_id, left_iri, 'operators', 'odrl:eq', 1 FROM t WHERE k % 2 = 0) {RANKED.format("")}""",
    "v3_overlay_facts": f"{TERMS} SELECT graph_id, left_iri, CASE WHEN k % 4 = 0 THEN 'xsd:date' WHEN k % 5 <> 4 THEN 'xsd:integer' END AS datatype, k % 2 = 0 AS closed, k % 7 = 0 AS plural, k % 3 = 0 AS values_exact FROM t",
    "v3_overlay_notes": f"""{TERMS} SELECT graph_id, 'label or note' AS note, left_iri AS about FROM t WHERE k % 9 = 0 UNION ALL SELECT graph_id, 'type', left_iri FROM t WHERE k % 8 = 0
      UNION ALL SELECT DISTINCT graph_id, 'property not read', 'prose:colour' FROM t WHERE k % 25 = 0""",
}
