"""Rules, options and reports on small made cases."""

import pytest
from pyspark.sql import functions as F

from clausework.model import RULES, Options, odrl_terms
from clausework.operators import hints, inherit, lists, pointers, report, rewrite, structure, vocabulary
from clausework.sources import flatten
from clausework.streaming.edits import reduce_edits


def test_catalogue_is_whole():
    assert len(RULES) == 33 and len({r[0] for r in RULES}) == 33
    assert len({t[0] for t in odrl_terms()}) == len(odrl_terms())


@pytest.mark.parametrize(
    "options,rule,closed,level",
    [
        (Options(structural=False), "odrl.policy-uid", False, "off"),
        (Options(structural=False), "odrl.constraint-incomplete", False, "error"),
        (Options(strict=False), "profile.not-loaded", False, "warning"),
        (Options(), "prose.value-not-allowed", True, "error"),
        (Options(), "prose.value-not-allowed", False, "info"),
        (Options(ruleset=1), "odrl.constraint-incomplete", False, "off"),
        (Options(fail_closed=True), "input.unchecked", False, "error"),
        (Options(deny_deprecated=True), "profile.deprecated-term", False, "error"),
        (Options(levels={"input.unreadable": "off"}), "input.unreadable", False, "error"),
        (Options(levels={"heuristic.duplicate-action": "info"}), "heuristic.duplicate-action", False, "info"),
    ],
)
def test_levels(options, rule, closed, level):
    assert options.level(rule, closed) == level


def test_gap_is_never_a_violation(spark):
    f = spark.createDataFrame([(1, "error", True), (2, "error", False), (2, "info", False), (3, "warning", False)], "doc_id long, severity string, gap boolean")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id long")
    got = {r.doc_id: r.verdict for r in report.verdicts(f, docs, ["doc_id"]).collect()}
    assert got == {1: "incomplete", 2: "violations", 3: "conforms", 4: "conforms"}


def fnv(*parts):
    h = 0xCBF29CE484222325
    for i, p in enumerate(parts):
        for b in (b"\0" if i else b"") + p.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def test_fingerprint(spark):
    rows = [("odrl.policy-uid", "policy[0]", "x"), ("a", "", "é"), ("", "", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r[0] for r in df.select(report.fingerprint(F.col("a"), F.col("b"), F.col("c"))).collect()] == [fnv(*r) for r in rows]


def test_lineage_with_two_parents_and_a_circle(spark):
    links = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 4), (0, 4, 1)], "doc_id long, policy_ix int, parent_ix int")
    got = inherit.lineages(links.withColumn("parent", F.lit("x"))).where("policy_ix = 1").orderBy("ix").collect()
    assert [r.ancestor_ix for r in got] == [2, 4, 3]
    assert {r.policy_ix for r in inherit.on_cycle(links).collect()} == {1, 2, 3, 4}


def brute_lineage(edges, start):
    """Depth first over parents in order, each ancestor at its least path of turns."""
    out, stack = {}, [((), start, {start})]
    while stack:
        path, node, seen = stack.pop()
        for turn, up in enumerate(sorted({b for a, b in edges if a == node})):
            if up not in seen:
                at = (*path, turn)
                if up not in out or at < out[up]:
                    out[up] = at
                    stack.append((at, up, seen | {up}))
    return sorted(out, key=out.get)


def test_lineages_of_diamonds_and_circles(spark):
    one = [(k, k + 1) for k in range(20)]  # a chain
    two = [x for k in range(5) for x in ((3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 3), (3 * k + 2, 3 * k + 3))]  # stacked diamonds
    three = [(0, 1), (1, 2), (2, 0), (3, 1), (4, 4), (5, 4)]  # circles with tails
    links = spark.createDataFrame([(d, a, b) for d, e in enumerate((one, two, three)) for a, b in e] + [(2, 6, None)], "doc_id long, policy_ix int, parent_ix int").withColumn("parent", F.lit("x"))
    got = {}
    for r in inherit.lineages(links).orderBy("doc_id", "policy_ix", "ix").collect():
        got.setdefault((r.doc_id, r.policy_ix), []).append(r.ancestor_ix)
    for d, e in ((0, one), (2, three)):
        for start in {a for a, _ in e}:
            assert got.get((d, start), []) == brute_lineage(e, start), (d, start)
    for start in (0, 4, 12):
        assert sorted(got[1, start]) == sorted(brute_lineage([x for x in two if x[0] >= start], start))
    assert got[1, 9] == brute_lineage([x for x in two if x[0] >= 9], 9)
    assert {(r.doc_id, r.policy_ix) for r in inherit.on_cycle(links).collect()} == {(2, 0), (2, 1), (2, 2), (2, 4)}


def test_masks_go_down(spark):
    edges = [(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 4, 1), (1, 1, 2), (1, 1, 3), (1, 3, 4), (1, 5, 1)]
    links = spark.createDataFrame([*edges, (0, 3, None)], "doc_id long, policy_ix int, parent_ix int").withColumn("parent", F.lit("x"))
    own = {(0, 1): 1, (0, 2): 0, (0, 3): 0, (0, 4): 2, (0, 9): 8, (1, 1): 0, (1, 2): 4, (1, 3): 0, (1, 4): 8, (1, 5): 1}
    rows = [(d, p, *["v" if m >> i & 1 else None for i in range(4)]) for (d, p), m in own.items()]
    policies = spark.createDataFrame(rows, "doc_id long, policy_ix int, assigner string, assignee string, target string, action string")
    got = {(r.doc_id, r.policy_ix): r.mask for r in inherit.inherited_mask(policies, links).collect()}
    assert got == {(0, 1): 17, (0, 2): 17, (0, 3): 17, (0, 4): 19, (0, 9): 8, (1, 1): 12, (1, 2): 4, (1, 3): 8, (1, 4): 8, (1, 5): 13}


def test_a_long_circle_and_a_long_list(spark):
    n = 10_000
    ring = spark.range(n).select(F.lit(0).cast("long").alias("doc_id"), F.col("id").alias("node"), ((F.col("id") + 1) % n).alias("to"))
    tail = spark.range(500).select(F.lit(0).cast("long").alias("doc_id"), (F.col("id") + n).alias("node"), (F.col("id") + n - 1).alias("to"))
    assert pointers.circles(ring.unionByName(tail), "doc_id").agg(F.count("*"), F.max("node")).first()[:] == (n, n - 1)
    m = 100_000
    cell = lambda i: F.concat(F.lit("b"), i.cast("string"))
    first = spark.range(m).select(F.lit(1).alias("graph_id"), cell(F.col("id")).alias("s"), F.lit("rdf:first").alias("p"), F.col("id").cast("string").alias("o_iri"))
    rest = spark.range(m).select(F.lit(1).alias("graph_id"), cell(F.col("id")).alias("s"), F.lit("rdf:rest").alias("p"), F.when(F.col("id") < m - 1, cell(F.col("id") + 1)).otherwise("b50000").alias("o_iri"))
    got = lists.walk_lists(first.unionByName(rest))
    assert got.agg(F.count("*"), F.count_if(F.col("ix") == F.col("item").cast("int")), F.countDistinct("head")).first()[:] == (m, m, 1)


@pytest.mark.parametrize(
    ("value", "low", "high", "outside"),
    [("0", "1", "100", True), ("101", "1", "100", True), ("50", None, "100", False), ("2030-01-01", "2020-01-01", "2025-01-01", True), ("2020-01-01T10:00:00Z", "2020-01-01", "2025-01-01", False),
     ("2019-12-31T23:59:59Z", "2020-01-01", None, True), ("5", "2020-01-01", "2021-01-01", False), ("x", "1", "2", False), (None, "1", "2", False), (" 7 ", "1", "6", True), ("2025-01-01", None, "2025-01-01T08:00:00Z", False)],
)
def test_bounds(spark, value, low, high, outside):
    df = spark.createDataFrame([(value, low, high)], "v string, l string, h string")
    assert df.select(hints.outside_bounds(F.col("v"), F.col("l"), F.col("h"))).first()[0] is outside


def test_edits_as_table(spark):
    log = [(1, 1, "SetText", "a", "x", None), (1, 2, "SetText", "a", "y", 5), (1, 3, "SetText", "a", "z", 1), (1, 4, "Remove", "a", None, None), (1, 5, "Remove", "a", None, None),
           (1, 6, "Add", "a", "w", 3), (1, 7, "Add", "a", "v", None), (2, 1, "SetIri", "b", None, 0)]
    df = spark.createDataFrame(log, "doc_id long, seq long, op string, slot string, value string, expect long").repartition(3)
    got = [(r.doc_id, r.seq, r.accepted, r.version, r.value) for r in rewrite.replay_edits(df).orderBy("doc_id", "seq").collect()]
    assert got == [(1, 1, True, 1, "x"), (1, 2, False, 1, "x"), (1, 3, True, 2, "z"), (1, 4, True, 3, None), (1, 5, False, 3, None), (1, 6, True, 4, "w"), (1, 7, False, 4, "w"), (2, 1, True, 1, None)]
    assert [(r.doc_id, r.seq, r.version) for r in rewrite.stale_edits(df).collect()] == [(1, 2, 1)]
    assert {(r.doc_id, r.slot, r.value, r.n) for r in rewrite.latest_edits(df.where("seq < 6")).collect()} == {(2, "b", None, 1)}
    assert rewrite.replay_edits(df.where("false")).count() == 0
    streamed = {}
    for d in (1, 2):
        _, _, told = reduce_edits(0, {}, [e[1:] for e in log if e[0] == d])
        streamed |= {(d, seq): (ok, version, value) for seq, ok, version, _, value in told}
    assert streamed == {(d, seq): (ok, version, value) for d, seq, ok, version, value in got}


def test_rows_order_does_not_matter(spark):
    df = spark.createDataFrame([(0, i, f"policy[{i}]", "r", "error", i % 2 == 0, None) for i in range(40)], "doc_id long, policy_ix int, path string, rule string, severity string, gap boolean, written string")
    a = report.distinct_gaps(df).orderBy("ix").collect()
    b = report.distinct_gaps(df.orderBy(F.rand(3)).repartition(7)).orderBy("ix").collect()
    assert a == b


def test_flatten_keeps_order_text_and_errors():
    rows = flatten.rows_of('{"b": 5.0, "a": [1e3, {"c": null}], "b": true}')
    assert [(r[0], r[5], r[6]) for r in rows] == [("", "object", None), ("b", "boolean", "true"), ("a", "list", None), ("a[0]", "number", "1e3"), ("a[1]", "object", None), ("a[1].c", "null", None)]
    for bad in (None, "", "{", "NaN", "[" * 100_000):
        assert flatten.rows_of(bad)[0][4 + 1] == "error"


def test_strip_takes_what_lies_below(spark):
    docs = spark.createDataFrame([(1, '{"permission": [{"duty": [{"uid": "d"}], "uid": "p"}], "dutyfree": 1}')], "doc_id long, text string")
    left = {r.path for r in rewrite.strip_out_of_scope(flatten.flatten(docs), ["duty"]).collect()}
    assert left == {"", "permission", "permission[0]", "permission[0].uid", "dutyfree"}


def test_read_policy_files(spark, tmp_path):
    root = tmp_path / "build" / "schema in+"
    for name in ("top.json", "a/b/x.json", "b.jsonld", "my-schema.json", "c.txt", "node_modules/d.json", "a/schemas/e.json", "a/build/f.json", "dist/g.json", "vendor/h.json"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("{}")
    want = {"top.json", "a/b/x.json", "b.jsonld", "dist/g.json", "vendor/h.json"}
    assert {r.rel_path for r in flatten.read_policy_files(spark, str(root)).collect()} == want
    assert {r.rel_path for r in flatten.read_policy_files(spark, str(root) + "/").collect()} == want


def test_ntriples(spark):
    lines = ['<http://a> <http://p> "x\\"y"@en .', "<http://a> <http://p> <http://b> .", "# no", '<http://a b> <http://p> "z" .', '_:b <http://p> "1"^^<http://t> .']
    got = vocabulary.read_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.s, r.o_iri, r.o_value, r.o_lang, r.o_datatype) for r in got] == [("http://a", None, 'x"y', "en", None), ("http://a", "http://b", None, None, None), ("_:b", None, "1", None, "http://t")]


def test_duplicate_actions(spark):
    rows = [(1, "r", 0, "use", "x"), (1, "r", 1, "use", "y"), (1, "r", 2, "use", "x"), (1, "s", 0, "use", None), (1, "s", 1, "use", None)]
    got = structure.duplicate_actions(spark.createDataFrame(rows, "doc_id long, owner string, ix int, iri string, refinements string")).collect()
    assert {(r.owner, r.ix): r.removable for r in got} == {("r", 1): False, ("r", 2): True, ("s", 1): True}


def test_one_large_document(spark):
    """A document with 100 000 rules: one circle through all of its policies."""
    n = 100_000
    rules = spark.range(n).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("policy_ix"), F.concat(F.lit("policy[0].permission["), F.col("id").cast("string"), F.lit("]")).alias("path"), F.lit("permission").alias("list"),
        *[F.lit(None).cast("string").alias(c) for c in ("assigner", "assignee", "target", "action")])
    masks = spark.createDataFrame([(0, 0, 0)], "doc_id long, policy_ix int, mask int")
    classes = spark.createDataFrame([(0, 0, "Offer")], "doc_id long, policy_ix int, class string")
    got = {r["rule"]: r["count"] for r in structure.rule_findings(rules, masks, classes).groupBy("rule").count().collect()}
    assert got == {"odrl.offer-assigner": n, "odrl.rule-target": n, "odrl.rule-action": n}


def test_ntriples_escapes(spark):
    lines = [r'<http://a> <http://p> "caf\u00E9\t\"\\n\U0001F600\'x" .', r"<http://a/\u00e9> <http://p> <http://b> ."]
    got = vocabulary.read_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (got[0].o_value, got[1].s) == ('café\t"\\n\U0001F600\'x', "http://a/é")


def test_compact_and_full_parents_meet(spark):
    policies = spark.createDataFrame([(1, 0, "http://x/a"), (1, 1, "ex:b"), (1, 2, "ex:a"), (2, 0, "http://x/a")], "doc_id int, policy_ix int, uid string")
    inherits = spark.createDataFrame([(1, 3, "ex:a"), (1, 4, "http://x/b"), (2, 3, "ex:a"), (1, 5, "ex://a")], "doc_id int, policy_ix int, parent string")
    prefixes = spark.createDataFrame([(1, "ex", "http://x/")], "doc_id int, prefix string, namespace string")
    got = {(r.doc_id, r.policy_ix): r.parent_ix for r in inherit.inherit_links(policies, inherits, prefixes).collect()}
    assert got == {(1, 3): 0, (1, 4): 1, (2, 3): None, (1, 5): None}


def test_references_end_at_what_is_not_declared(spark):
    rows = [(1, "a", "b"), (1, "b", "gone"), (1, "c", None), (1, "d", "c"), (1, "x", "y"), (1, "y", "x")]
    got = {r.id: r.target for r in vocabulary.resolve_references(spark.createDataFrame(rows, "doc_id int, id string, ref string")).collect()}
    assert got == {"a": "gone", "b": "gone", "c": "c", "d": "c", "x": None, "y": None}


def test_lineages_of_a_large_circle_end_at_the_limit(spark):
    n = 3000
    links = spark.range(n).selectExpr("cast(id % 2 as int) as doc_id", "cast(id div 2 as int) as policy_ix", f"cast((id div 2 + 1) % {n // 2} as int) as parent_ix")
    got = inherit.lineages(links, cap=2000).orderBy("doc_id", "policy_ix", "ix").collect()
    m = n // 2
    want = [(p, (p + 1 + k) % m, k) for p in range(2) for k in range(m - 1)][:2000]
    assert [(r.policy_ix, r.ancestor_ix, r.ix) for r in got if r.doc_id == 0] == want
    assert len(got) == 4000
