"""Rows are read once, and frequent terms do not fill a task."""

from pyspark.sql import functions as F

from clausework.operators import conditions, graphs, lists, locks, messages, pointers, prose, report, resolve, rewrite
from clausework.sources import flatten
from clausework.sources.shared import cut


def test_strip_is_one_pass_over_intervals(spark):
    docs = spark.createDataFrame([(1, '{"duty": {"x": [1]}, "duty.y": 2, "a": {"duty": 3, "b": 4}}'), (2, '{"a": 1}')], "doc_id long, text string")
    left = rewrite.strip_out_of_scope(flatten.flatten(docs), ["duty"])
    assert sorted((r.doc_id, r.path) for r in left.collect()) == [(1, ""), (1, "a"), (1, "a.b"), (1, "duty.y"), (2, ""), (2, "a")]  # duty.y is a name of its own
    assert left._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_fixes_of_findings_that_say_their_iri(spark):
    found = spark.createDataFrame([(1, "p", "action", "x:t", "profile.unbound-prefix", "urn:x#t")] * 2, "doc_id long, path string, slot string, written string, rule string, iri string")
    assert [r.replacement for r in lists.safe_fixes(found, None).collect()] == ["urn:x#t"]


def test_glossary_looks_distinct_terms_up(spark):
    uses = spark.createDataFrame([(1, 0, "urn:t", 2), (1, 0, "urn:t", 1), (1, 0, "urn:u", 0), (1, 0, None, 0)], "doc_id long, policy_ix int, iri string, ord int")
    found = prose.glossary(uses, spark.createDataFrame([("urn:t",), ("urn:t",), ("urn:v",)], "iri string"))
    assert [(r.ix, r.iri) for r in found.collect()] == [(0, "urn:t")]
    assert "ResolvedHint" in found._jdf.queryExecution().analyzed().toString()


def test_paths_that_end_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(pointers, "cut", lambda df, name: (lambda table: written.append(table.count()) or table if name == "orbit" else table)(cut(df, name)))
    steps = spark.createDataFrame([(1, f"c{i}", f"c{i + 1}") for i in range(6)], "k int, node string, to string")
    found = pointers.orbits(steps, spark.createDataFrame([(1, "c0")], "k int, start string"), "k")
    assert sorted((r.ix, r.at) for r in found.collect()) == [(i, f"c{i}") for i in range(7)]
    assert sum(written) == 7
    ring = spark.createDataFrame([(1, str(i), str((i + 1) % 5)) for i in range(5)] + [(1, "t", "3")], "k int, node string, to string")
    found = pointers.orbits(ring, spark.createDataFrame([(1, "t"), (1, "2")], "k int, start string"), "k")
    assert sorted((r.start, r.ix, r.at) for r in found.collect()) == sorted([("t", 0, "t")] + [("t", i + 1, str((3 + i) % 5)) for i in range(5)] + [("2", i, str((2 + i) % 5)) for i in range(5)])


def test_trees_are_opened_for_the_tables_that_are_asked_for(spark, monkeypatch):
    opened = []
    edges = graphs._edges
    monkeypatch.setattr(graphs, "_edges", lambda triples, roles: opened.append(roles) or edges(triples, roles))
    rows = [(0, "q", graphs.RDF + "type", "urn:Request"), (1, "q", "urn:policy", "p"), (2, "p", graphs.ODRL + "permission", "r"), (3, "r", graphs.ODRL + "constraint", "c")]
    triples = spark.createDataFrame([("g", *r, None, None, None) for r in rows], "graph_id string, seq long, s string, p string, o_iri string, o_value string, o_type string, o_lang string")
    names, bases = graphs.Extension("urn:Request", "urn:policy", "urn:up", "urn:kind", "urn:key"), spark.createDataFrame([("g", "urn:g#")], "graph_id string, base string")
    made = lambda name: [r.path for r in graphs.policies_from_triples(triples, names, bases, {}, (name,))[name].collect()]
    assert (made("policies"), made("rules"), made("constraints")) == (["policy[0]"], ["policy[0].permission[0]"], ["policy[0].permission[0].constraint[0]"])
    assert opened == [("rule",), ("rule", "action", "constraint")]


def test_only_the_columns_that_are_read_leave_the_flattening(spark):
    docs = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}]}'), (2, "no")], "doc_id long, text string")
    rows = flatten.flatten(docs, "key", "kind")
    assert rows.columns == ["key", "kind"]
    assert sorted((r.key or "", r.kind) for r in rows.collect()) == [("", "error"), ("", "object"), ("a", "list"), ("a", "number"), ("a", "object"), ("b", "string")]
    assert [(r.path, r.seq, r.last) for r in flatten.flatten(docs).where("doc_id = 1").orderBy("seq").collect()] == [("", 0, 4), ("a", 1, 4), ("a[0]", 2, 2), ("a[1]", 3, 4), ("a[1].b", 4, 4)]


def test_contexts_are_looked_for_in_one_pass(spark):
    docs = spark.createDataFrame([(1, '{"@context": "urn:c", "x": {"@context": {"y": "urn:y"}}}')], "doc_id long, text string")
    found = rewrite.unread_contexts(flatten.flatten(docs))
    assert sorted((r.form, r.iri) for r in found.collect()) == [("nested", None), ("remote", "urn:c")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_proposals_bring_their_rules(spark):
    judged = spark.createDataFrame([(1, "p", "action", "x", ["profile.wrong-kind", "profile.unknown-term", "profile.deprecated-term"]), (1, "q", "action", "y", ["profile.deprecated-term"])], "doc_id long, path string, slot string, written string, rules array<string>")
    told = lists.admissible(judged, spark.createDataFrame([(1, "r", "action", "z")], "doc_id long, path string, slot string, written string"))
    assert sorted((r.path, r.rule, r.ok) for r in told.collect()) == [("p", "profile.unknown-term", False), ("q", None, True), ("r", None, True)]
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_uses_are_not_dealt_by_term(spark):
    uses = spark.createDataFrame([(1, 0, "urn:a#t"), (1, 1, "urn:a#t"), (1, 0, "urn:z")], "doc_id long, policy_ix int, iri string")
    policies = spark.createDataFrame([(1, 0, "urn:a"), (1, 1, "urn:b")], "doc_id long, policy_ix int, profile string")
    terms = spark.createDataFrame([("a", "urn:a#t")], "profile_id string, iri string")
    found = resolve.undeclared_profiles(uses, policies, terms, spark.createDataFrame([("a", "urn:a")], "profile_id string, iri string"))
    assert sorted((r.policy_ix, r.iri, r.declares) for r in found.collect()) == [(0, "urn:a#t", True), (1, "urn:a#t", False)]
    assert "ResolvedHint" in found._jdf.queryExecution().analyzed().toString()


def test_policies_are_found_in_passes_not_level_by_level(spark, monkeypatch):
    written = []
    monkeypatch.setattr(messages, "cut", lambda df, name: written.append(name) or cut(df, name))
    deep = '{"permission": [], "duty": {"permission": []}, "@context": {"permission": []}}'
    for k in range(12):
        deep = f'{{"x{k}": [{deep}]' + (f', "@context": ["c{k}"], "y": {{"@context": "z"}}' if k % 5 == 3 else "") + "}"
    found = messages.policies_in(flatten.flatten(spark.createDataFrame([(1, f"[{deep}, {deep}]")], "doc_id long, text string"))).orderBy("policy_ix").collect()
    assert [r.path.count("x") for r in found] == [12, 12] and [r.context == r.path + ".@context" for r in found] == [True, True]
    assert len(written) <= 3


def test_locked_nodes_are_found_by_place(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(locks, "cut", lambda df, name: written.setdefault(name, df.columns) and cut(df, name))
    docs = spark.createDataFrame([(1, '{"permission": [{"action": {}}]}')], "doc_id long, text string")
    assert [(r.path, r.by) for r in locks.locked_nodes(flatten.flatten(docs)).collect()] == [("permission[0].action", "permission[0].action")]
    assert "path" not in written["owned"] + written["roles"]


def test_lines_of_single_conditions_need_no_key(spark):
    rows = [(1, "p.constraint[0]", "g"), (1, "p.constraint[0].child[10]", "b"), (1, "p.constraint[0].child[2]", "a"), (1, "q[3]", "leaf")]
    got = conditions.condition_lines(spark.createDataFrame(rows, "doc_id int, path string, text string"), ["doc_id"])
    assert {r.path: r.line for r in got.collect()} == {"p.constraint[0]": "g; a; b", "q[3]": "leaf"}
    keyed = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in x and "transform(split(" in x]
    assert keyed and all("transform(split(path" not in x for x in keyed)


def test_fingerprints_are_made_in_batches(spark):
    made = spark.createDataFrame([("a", "p", "t"), ("a", None, "t")], "a string, b string, c string").select(report.fingerprint(F.col("a"), F.col("b"), F.col("c")).alias("f"))
    assert [r.f for r in made.collect()][1] is None
    assert "ArrowEvalPython" in made._jdf.queryExecution().optimizedPlan().toString()
