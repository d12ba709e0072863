"""A corpus of policies derived from the driver's tables.

One policy for each order, one rule for each line, one or two constraints for
each rule, in the star of tables that the operators work on.  The derivations
are SQL that Spark and DuckDB read alike, so a check starts from the same rows;
what is checked comes after them.

Documents are buckets of 1000 orders.  Inheritance follows the order's number
within its bucket: chains, two circles, a policy that inherits from itself, and
parents that are not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausework.model import odrl_terms
from clausework.sources.shared import compile_short, cut, estimate_by_rows, sent

A, B = "https://example.org/a#", "https://example.org/b#"
#: Terms of the profiles that are made from parts.
PART = "https://example.org/parts#"

POLICIES = """
SELECT cast(floor(o_orderkey / 1000) AS bigint) AS doc_id,
  cast(o_orderkey % 1000 AS int) AS policy_ix,
  CASE WHEN o_orderkey % 29 <> 0 THEN concat('urn:policy:', cast(o_orderkey AS string)) END AS uid,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Offer' WHEN '2-HIGH' THEN 'Agreement' WHEN '3-MEDIUM' THEN 'Set'
    WHEN '4-NOT SPECIFIED' THEN 'ex:ResearchAgreement' END AS kind,
  CASE WHEN o_custkey % 7 = 0 THEN concat('urn:party:h', cast(o_custkey % 50 AS string)) END AS assigner,
  CASE WHEN o_custkey % 5 <> 0 THEN concat('urn:party:c', cast(o_custkey AS string)) END AS assignee,
  CASE WHEN o_orderkey % 17 = 0 THEN concat('urn:asset:o', cast(o_orderkey AS string)) END AS target,
  CASE WHEN o_orderkey % 19 = 0 THEN 'use' END AS action,
  CASE o_orderstatus WHEN 'F' THEN 'perm' WHEN 'O' THEN 'prohibit' WHEN 'P' THEN 'ex:newest' END AS conflict,
  CASE o_custkey % 3 WHEN 0 THEN 'https://example.org/a' WHEN 1 THEN 'https://example.org/b/' ELSE 'https://example.org/c' END AS profile,
  CASE WHEN o_orderkey % 1000 = 1 THEN 3 WHEN o_orderkey % 1000 = 3 THEN 1
    WHEN o_orderkey % 1000 = 5 THEN 7 WHEN o_orderkey % 1000 = 7 THEN 9 WHEN o_orderkey % 1000 = 9 THEN 5
    WHEN o_orderkey % 1000 = 11 THEN 11
    WHEN o_orderkey % 1000 > 0 AND (o_orderkey % 1000) % 97 = 0 THEN -1
    WHEN o_orderkey % 1000 > 0 AND (o_orderkey % 1000) % 4 = 0 THEN cast(floor((o_orderkey % 1000) / 2) AS int) END AS parent_ix
FROM {orders}
"""

# The parent by its uid, every fifth as a compact IRI, which only some documents bind; -1 is a policy that no document holds.
INHERITS = """
SELECT doc_id, policy_ix, CASE WHEN parent_ix = -1 THEN 'urn:policy:none' WHEN policy_ix % 5 = 0 AND doc_id % 2 = 0 THEN concat('pol:', cast(doc_id * 1000 + parent_ix AS string)) ELSE concat('urn:policy:', cast(doc_id * 1000 + parent_ix AS string)) END AS parent
FROM {policies} WHERE parent_ix IS NOT NULL
"""

LINES = """
SELECT cast(floor(l_orderkey / 1000) AS bigint) AS doc_id, cast(l_orderkey % 1000 AS int) AS policy_ix,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS int) AS rule_ix,
  l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, cast(l_quantity AS int) AS quantity,
  cast(cast(l_shipdate AS date) AS string) AS shipped, p_type
FROM {lineitem} LEFT JOIN {part} ON p_partkey = l_partkey
"""

RULES = """
SELECT doc_id, policy_ix, rule_ix,
  CASE l_returnflag WHEN 'N' THEN 'permission' WHEN 'A' THEN 'prohibition' ELSE 'obligation' END AS list,
  concat('policy[', cast(policy_ix AS string), '].', CASE l_returnflag WHEN 'N' THEN 'permission' WHEN 'A' THEN 'prohibition' ELSE 'obligation' END,
    '[', cast(rule_ix AS string), ']') AS path,
  CASE WHEN l_suppkey % 3 <> 0 THEN concat('urn:party:s', cast(l_suppkey AS string)) END AS assigner,
  CASE WHEN l_linenumber % 5 = 0 THEN concat('urn:party:r', cast(l_partkey % 40 AS string)) END AS assignee,
  CASE WHEN l_partkey % 11 <> 0 THEN concat('urn:asset:', cast(l_partkey AS string)) END AS target,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CASE p_type WHEN 'STANDARD' THEN 'use' WHEN 'ECONOMY' THEN 'odrl:distribute'
    WHEN 'MEDIUM' THEN 'ex:train' WHEN 'PROMO' THEN 'copy' WHEN 'LARGE' THEN 'ex:distil' ELSE 'foo:bar' END END AS action
FROM {lines}
"""

CONSTRAINTS = """
SELECT doc_id, policy_ix, rule_ix, k AS con_ix,
  concat('policy[', cast(policy_ix AS string), '].', CASE l_returnflag WHEN 'N' THEN 'permission' WHEN 'A' THEN 'prohibition' ELSE 'obligation' END,
    '[', cast(rule_ix AS string), '].constraint[', CASE WHEN l_linenumber % 3 = 0 THEN '0].child[' ELSE '' END, cast(k AS string), ']') AS path,
  CASE l_linenumber % 6 WHEN 0 THEN 'and' WHEN 3 THEN 'or' END AS logical_op,
  CASE (l_suppkey + k) % 6 WHEN 0 THEN 'dateTime' WHEN 1 THEN 'count' WHEN 2 THEN 'odrl:percentage' WHEN 3 THEN 'ex:purpose' WHEN 4 THEN 'ex:region' END AS lft,
  CASE (l_linenumber + k) % 7 WHEN 0 THEN 'eq' WHEN 1 THEN 'neq' WHEN 2 THEN 'gt' WHEN 3 THEN 'odrl:lteq' WHEN 4 THEN 'isAnyOf' WHEN 5 THEN 'isNoneOf'
    ELSE 'ex:near' END AS operator,
  CASE WHEN l_partkey % 13 = 0 THEN 'missing' WHEN (l_suppkey + k) % 6 = 3 THEN 'iri' ELSE 'literal' END AS right_kind,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CASE (l_suppkey + k) % 6 WHEN 0 THEN shipped WHEN 1 THEN cast(quantity AS string)
    WHEN 2 THEN cast(quantity * 3 AS string) WHEN 3 THEN concat('ex:purpose-', cast(l_partkey % 5 AS string))
    WHEN 4 THEN concat('R', cast(l_partkey % 7 AS string)) ELSE '' END END AS raw,
  CASE WHEN l_partkey % 13 = 0 OR (l_suppkey + k) % 6 = 3 THEN 0 WHEN (l_partkey + k) % 9 = 0 THEN 2 ELSE 1 END AS n_values,
  CASE WHEN l_partkey % 13 = 0 OR (l_suppkey + k) % 6 = 3 THEN NULL WHEN l_orderkey % 4 = 0 THEN 'xsd:date' WHEN l_orderkey % 4 = 1 THEN 'xsd:integer'
    WHEN l_orderkey % 4 = 2 THEN 'xsd:boolean' END AS datatype,
  CASE WHEN (l_suppkey + k) % 6 = 1 AND l_partkey % 2 = 0 THEN 'ex:view' WHEN (l_suppkey + k) % 6 = 1 AND l_partkey % 3 = 0 THEN 'ex:minute' END AS unit
FROM {lines} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) ks
WHERE k = 0 OR l_linenumber % 2 = 0
"""


def values(rows: list[tuple], names: str) -> str:
    """Rows as a VALUES relation that both engines read."""

    def lit(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        return str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names})"


# A document binds ex and pol in every other bucket; odrl needs no binding.
PREFIXES = """
SELECT DISTINCT cast(floor(o_orderkey / 1000) AS bigint) AS doc_id, 'ex' AS prefix, 'https://example.org/a#' AS namespace
FROM {orders} WHERE cast(floor(o_orderkey / 1000) AS bigint) % 2 = 0
UNION ALL SELECT DISTINCT cast(floor(o_orderkey / 1000) AS bigint), 'pol', 'urn:policy:' FROM {orders} WHERE cast(floor(o_orderkey / 1000) AS bigint) % 2 = 0
"""

PROFILE_ROWS = values([("a", 1, "https://example.org/a", "ex", A, "https://example.org/b"), ("b", 2, "https://example.org/b", "bb", B, "https://example.org/a")],
                  "profile_id, load_order, iri, prefix, namespace, imports")
# A profile for each nation with a supplier.
PROFILES = f"""{PROFILE_ROWS} UNION ALL SELECT DISTINCT concat('n', cast(s_nationkey AS string)), 10 + s_nationkey, concat('https://example.org/base/', cast(s_nationkey AS string)),
  concat('n', cast(s_nationkey AS string)), concat('https://example.org/n', cast(s_nationkey AS string), '#'), cast(NULL AS string) FROM {{supplier}}"""
TERM_ROWS = values(
    [
        ("a", 1, 0, A + "train", "Action", False),
        ("a", 1, 1, A + "purpose", "LeftOperand", False),
        ("a", 1, 2, A + "region", "LeftOperand", True),
        ("a", 1, 3, A + "ResearchAgreement", "PolicyClass", False),
        ("a", 1, 4, A + "newest", "Action", False),
        ("a", 1, 5, A + "near", "Operator", False),
        ("a", 1, 6, A + "purpose-0", "RightOperand", False),
        ("a", 1, 7, A + "purpose-1", "RightOperand", False),
        ("a", 1, 8, A + "purpose-2", "RightOperand", False),
        ("a", 1, 9, A + "view", "Unit", False),
        ("b", 2, 0, A + "region", "LeftOperand", False),
        ("b", 2, 1, A + "newest", "ConflictTerm", False),
        ("b", 2, 2, B + "lend", "Action", True),
        ("b", 2, 3, A + "minute", "Unit", False),
    ],
    "profile_id, load_order, term_ix, iri, kind, deprecated",
)
# A term for each part; every sixth is declared by the second profile too, as another kind.
TERMS = f"""{TERM_ROWS} UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END, cast(100 + p_partkey AS int), concat('{PART}t', cast(p_partkey AS string)),
  CASE p_size % 3 WHEN 0 THEN 'Action' WHEN 1 THEN 'LeftOperand' ELSE 'RightOperand' END, p_size % 10 = 0 FROM {{part}}
UNION ALL SELECT 'b', 2, cast(100 + p_partkey AS int), concat('{PART}t', cast(p_partkey AS string)), 'Unit', false FROM {{part}} WHERE p_partkey % 6 = 0"""
HINT_ROWS = values(
    [
        ("http://www.w3.org/ns/odrl/2/count", "xsd:integer", "1", "40", None, False),
        ("http://www.w3.org/ns/odrl/2/percentage", "xsd:integer", "0", "100", None, True),
        ("http://www.w3.org/ns/odrl/2/dateTime", "xsd:date", "1993-06-01", "1997-06-30T12:00:00Z", None, False),
        (A + "region", None, None, None, "^R[0-4]$", True),
    ],
    "left_iri, datatype, lo, hi, pattern, closed",
)
HINTS = f"""{HINT_ROWS} UNION ALL SELECT concat('{PART}t', cast(p_partkey AS string)), 'xsd:integer', '0', cast(p_size AS string), cast(NULL AS string), p_partkey % 4 = 0 FROM {{part}} WHERE p_size % 3 = 1 OR p_partkey % 50 = 0"""
HINT_OPERATORS = values(
    [("http://www.w3.org/ns/odrl/2/count", "eq"), ("http://www.w3.org/ns/odrl/2/count", "lteq"), ("http://www.w3.org/ns/odrl/2/percentage", "gt"),
     (A + "purpose", "isAnyOf"), (A + "purpose", "eq")],
    "left_iri, op",
)
#: One list is closed, of literals and an IRI.
HINT_VALUE_ROWS = values(
    [(A + "purpose", A + "purpose-0", 0, False), (A + "purpose", A + "purpose-1", 1, False), (A + "purpose", A + "purpose-2", 2, False),
     (A + "region", "http://www.w3.org/ns/odrl/2/R2", 0, False), (A + "region", "R0", 1, True), (A + "region", "R6", 2, True)],
    "left_iri, value, ix, literal",
)
HINT_VALUES = f"""{HINT_VALUE_ROWS} UNION ALL SELECT concat('{PART}t', cast(p_partkey % 50 AS string)), concat('{PART}v', cast(p_partkey AS string)),
  cast(row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) - 1 AS int), false FROM {{part}} WHERE p_size % 2 = 0"""
HINT_UNITS = values([("http://www.w3.org/ns/odrl/2/count", A + "view")], "left_iri, unit")
#: What a larger set of profiles builds on; one import is not loaded.
IMPORT_ROWS = values([("a", "https://example.org/b#"), ("a", "https://example.org/base"), ("a", "https://example.org/base"), ("b", "http://www.w3.org/ns/odrl/2/")], "profile_id, import_iri")
IMPORTS = f"""{IMPORT_ROWS} UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END, concat('https://example.org/base/', cast(s_suppkey % 40 AS string)) FROM {{supplier}}"""
#: child, parent: links up a hierarchy of values, classes and actions, with a circle.
LINK_ROWS = values(
    [
        (A + "ResearchAgreement", "http://www.w3.org/ns/odrl/2/Agreement", "broader", 0),
        (A + "purpose-1", A + "purpose-0", "broader", 0),
        (A + "purpose-2", A + "purpose-1", "broader", 0),
        (A + "purpose-3", A + "purpose-1", "broader", 1),
        (A + "purpose-4", A + "purpose-3", "broader", 0),
        (A + "train", "http://www.w3.org/ns/odrl/2/use", "includedIn", 0),
        (A + "finetune", A + "train", "includedIn", 0),
        (A + "distill", A + "finetune", "includedIn", 1),
        (A + "loop1", A + "loop2", "broader", 0),
        (A + "loop2", A + "loop3", "broader", 0),
        (A + "loop3", A + "loop1", "broader", 0),
    ],
    "child, parent, predicate, ix",
)
# Parts below brands below types, with a circle of two types.
LINKS = f"""{LINK_ROWS} UNION ALL SELECT concat('{PART}t', cast(p_partkey AS string)), concat('{PART}', p_brand), 'broader', 0 FROM {{part}}
UNION ALL SELECT DISTINCT concat('{PART}', p_brand), concat('{PART}', p_type), 'broader', 1 FROM {{part}}
UNION ALL SELECT DISTINCT concat('{PART}', p_type), CASE p_type WHEN 'ECONOMY' THEN '{PART}PROMO' ELSE '{PART}ECONOMY' END, 'broader', 0 FROM {{part}} WHERE p_type IN ('ECONOMY', 'PROMO')"""
ODRL_TERMS = values(odrl_terms(), "iri, kind, core, deprecated")

#: name -> (SQL, the tables it reads)
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "policies": (POLICIES, ("orders",)),
    "inherits": (INHERITS, ("policies",)),
    "lines": (LINES, ("lineitem", "part")),
    "rules": (RULES, ("lines",)),
    "constraints": (CONSTRAINTS, ("lines",)),
    "prefixes": (PREFIXES, ("orders",)),
    "profiles": (PROFILES, ("supplier",)),
    "terms": (TERMS, ("part",)),
    "hints": (HINTS, ("part",)),
    "hint_operators": (HINT_OPERATORS, ()),
    "hint_values": (HINT_VALUES, ("part",)),
    "hint_units": (HINT_UNITS, ()),
    "imports": (IMPORTS, ("supplier",)),
    "links": (LINKS, ("part",)),
    "odrl_terms": (ODRL_TERMS, ()),
}


class Corpus:
    """The derived tables, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        estimate_by_rows(spark)
        compile_short(spark)
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in DERIVED:
                sql, needs = DERIVED[name]
                self._made[name] = self.spark.sql(sql, **{x: getattr(self, x) for x in needs}) if needs else self.spark.sql(sql)
                if name == "lines":  # several branches of a query read them: written once
                    self._made[name] = cut(self._made[name], name)
                elif name in ("prefixes", "profiles"):  # a few rows for each document or nation, made of far longer tables
                    self._made[name] = sent(self._made[name], name)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def ctes(*names: str) -> str:
    """``WITH`` and the named tables, with what they need before them, as SQL for the check."""
    order: list[str] = []

    def add(name: str) -> None:
        sql_needs = DERIVED.get(name)
        if sql_needs and name not in order:
            for x in sql_needs[1]:
                add(x)
            order.append(name)

    for name in names:
        add(name)
    text = [f"{n} AS ({DERIVED[n][0].format(**{x: x for x in DERIVED[n][1]}) if DERIVED[n][1] else DERIVED[n][0]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(text)
