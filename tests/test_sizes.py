"""What grows is not gathered in the driver, and joins see what they should."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.corpus import Corpus
from clausework.jobs import rules
from clausework.model import Options
from clausework.operators import conditions, graphs, hints, lists, report, resolve, structure
from clausework.sources.shared import cut, dealt, sent


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_files_of_many_rows_are_not_broadcast(spark):
    Corpus(spark, "/none")  # sets how tables are estimated
    rows = cut(spark.range(1_000_000).select(F.floor(F.col("id") / 1000).alias("doc_id"), (F.col("id") % 1000).alias("ix")), "rows")
    assert "BroadcastHashJoin" not in plan(rows.join(rows.where("ix > 1").select("doc_id", "ix", F.lit(1).alias("one")), ["doc_id", "ix"]))


def test_sent_counts_before_it_broadcasts(spark):
    keys = spark.range(20).withColumn("x", F.col("id"))
    many = cut(spark.range(1000), "many")
    assert "BroadcastHashJoin" in plan(many.hint("merge").join(sent(keys, "keys"), "id"))
    assert sent(keys, "keys", rows=19)._jdf.queryExecution().analyzed().toString().count("ResolvedHint") == 0
    assert sent(keys, "keys", rows=20)._jdf.queryExecution().analyzed().toString().count("ResolvedHint") == 1


def test_only_possible_findings_are_dealt_by_policy(spark):
    policies = spark.createDataFrame([(1, 0, "urn:a", None)], "doc_id long, policy_ix int, profile string, kind string")
    uses = spark.createDataFrame([(1, 0, "p", "action", "use"), (1, 0, "q", "action", "nope")], "doc_id long, policy_ix int, path string, slot string, written string")
    profiles = spark.createDataFrame([("a", 1, "urn:a", "a", "urn:a#")], "profile_id string, load_order int, iri string, prefix string, namespace string")
    terms = spark.createDataFrame([("a", 1, 0, "urn:a#t", "Action", False)], "profile_id string, load_order int, term_ix int, iri string, kind string, deprecated boolean")
    odrl = spark.createDataFrame([("http://www.w3.org/ns/odrl/2/use", "Action", True, False)], "iri string, kind string, core boolean, deprecated boolean")
    prefixes = spark.createDataFrame([], "doc_id long, prefix string, namespace string")
    found = resolve.term_findings(uses, policies, prefixes, profiles, terms, odrl)
    assert [(r.path, r.rule) for r in found.collect()] == [("q", "profile.unknown-term")]
    # Vocabularies are asked once for each distinct term, so uses meet few tables, and those of policies only where something can be found.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 5


def test_uses_bring_rules_not_vocabularies_to_their_policy(spark):
    c = Corpus(spark, "/root/testdata/sf0.001")
    uses = resolve.term_uses(c.policies, c.rules, c.constraints)
    found = resolve.term_findings(uses, c.policies, c.prefixes, c.profiles, c.terms, c.odrl_terms).select("doc_id", "rule", "written", "path")
    text = plan(found)
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text  # uses are not sorted by policy
    assert "kinds" not in text and "owner" not in text


def test_gaps_meet_findings_not_constraints(spark):
    rows = [(1, 0, "p", "l", "eq", "iri", "x", "urn:x", None, None, "urn:x"), (1, 1, "q", "l", "eq", "iri", "x", "urn:x", None, None, "urn:x"), (1, 1, "r", "m", "eq", "iri", "x", "urn:x", None, None, "urn:x")]
    names = "doc_id long, policy_ix int, path string, left_iri string, operator_name string, right_kind string, raw string, value_iri string, datatype string, unit_iri string, value_any string"
    made = lambda rows, names: spark.createDataFrame(rows, names)
    tables = (
        made([("l", None, None, None, None, True)], "left_iri string, datatype string, lo string, hi string, pattern string, closed boolean"),
        made([], "left_iri string, op string"), made([("l", "urn:y"), ("m", "urn:y")], "left_iri string, value string"), made([], "left_iri string, unit string"),
        made([(1, 1)], "doc_id long, policy_ix int"),
    )
    found = hints.hint_findings(made(rows, names), *tables)
    assert sorted(r.path for r in found.collect()) == ["p", "r"]  # q: a closed list in a policy with a gap; r: an open one
    assert "LeftAnti" in plan(found)  # findings are held back; constraints are not widened by their policy's gaps


def test_kinds_of_findings_are_summed_one_job_after_another(spark, monkeypatch):
    written = []
    monkeypatch.setattr(rules, "cut", lambda df, name: written.append((name, plan(df))) or cut(df, name))
    c = Corpus(spark, "/root/testdata/sf0.001")
    verdicts = rules.QUERIES["policy_verdicts"](c)
    assert len([n for n, _ in written if n == "part"]) == 4  # gaps, terms, structure, hints
    assert "Union" not in plan(verdicts) or plan(verdicts).count("Join") <= 2  # what is left adds up written counts
    one = report.verdicts(reduce(DataFrame.unionByName, rules._parts(c)), c.policies, rules.KEY)
    assert verdicts.exceptAll(one).isEmpty() and one.exceptAll(verdicts).isEmpty() and not one.isEmpty()


def test_rules_that_are_off_are_not_judged(spark, monkeypatch):
    """Tiers without structure still count unfinished constraints and parents that are not there."""
    c = Corpus(spark, "/root/testdata/sf0.001")
    whole = {r.rule for r in rules._structural(c).select("rule").distinct().collect()}
    assert whole > {"odrl.constraint-shape", "input.unchecked", "odrl.policy-uid"}
    monkeypatch.setattr(structure, "rule_findings", lambda *a: 1 / 0)
    monkeypatch.setattr(structure, "policy_findings", lambda *a: 1 / 0)
    some = {r.rule for r in rules._structural(c, Options(structural=False)).select("rule").distinct().collect()}
    assert some == whole & {"odrl.constraint-incomplete", "odrl.constraint-shape", "odrl.set-operator-cardinality", "input.unchecked"}


def test_joins_of_dealt_tables_shuffle_nothing(spark):
    made = lambda name: dealt(spark.range(1000).select((F.col("id") % 7).cast("string").alias("g"), F.concat(F.lit("n"), F.col("id").cast("string")).alias(name), "id"), "t", "g", name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        met = made("s").groupBy("g", "s").agg(F.max("id").alias("id")).join(made("node").select("g", F.col("node").alias("s")), ["g", "s"])
        assert met.count() == 1000 and "Exchange" not in plan(met)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("clausework_")]


def test_graphs_are_dealt_once(spark, monkeypatch):
    """triples and edges were shuffled again for each level; now what is dealt again are places only."""
    again = []
    monkeypatch.setattr(graphs, "dealt", lambda df, name, *keys, placed=False: again.append(name) or dealt(df, name, *keys, placed=placed))
    names = graphs.Extension("urn:Request", "urn:policy", "urn:up", "urn:kind", "urn:key")
    rows = [("q", graphs.RDF + "type", "urn:Request"), ("q", "urn:policy", "p"), ("p", graphs.ODRL + "permission", "r"), ("r", graphs.ODRL + "constraint", "c"), ("c", graphs.ODRL + "and", "l0")]
    for k in range(40):
        rows += [(f"l{k}", graphs.RDF + "first", f"x{k}"), (f"l{k}", graphs.RDF + "rest", f"l{k + 1}" if k < 39 else graphs.RDF + "nil")]
    triples = spark.createDataFrame([("g", k, *r, None, None, None) for k, r in enumerate(rows)], "graph_id string, seq long, s string, p string, o_iri string, o_value string, o_type string, o_lang string")
    made = graphs.policies_from_triples(triples, names, spark.createDataFrame([("g", "urn:g#")], "graph_id string, base string"), {}, ("constraints",))["constraints"]
    top = "policy[0].permission[0].constraint[0]"
    assert sorted(r.path for r in made.collect()) == sorted([top] + [f"{top}.child[{k}]" for k in range(40)])
    assert sorted(set(again)) == ["edges", "inside", "level", "nodes"] and again.count("nodes") == again.count("edges") == 1


def test_lists_longer_than_a_few_cells_and_circles(spark):
    rest = {f"c{k}": f"c{k + 1}" for k in range(49)} | {f"r{k}": f"r{(k + 1) % 30}" for k in range(30)} | {f"s{k}": f"s{(k + 1) % 3}" for k in range(3)} | {"t": "r5", "e": None, "c49": None}
    cells = spark.createDataFrame([("g", cell, "i" + cell, to) for cell, to in rest.items()], "graph_id string, cell string, item string, next string")
    starts = spark.createDataFrame([("g", s, head) for s, head in (("a", "c0"), ("b", "c0"), ("r", "r28"), ("t", "t"), ("s", "s1"), ("e", "e"), ("no", "none"))], "graph_id string, s string, head string")
    want = [("a", k, f"ic{k}") for k in range(50)] + [("b", k, f"ic{k}") for k in range(50)] + [("r", k, f"ir{(28 + k) % 30}") for k in range(30)]
    want += [("t", 0, "it")] + [("t", k + 1, f"ir{(5 + k) % 30}") for k in range(30)] + [("s", k, f"is{(1 + k) % 3}") for k in range(3)] + [("e", 0, "ie")]
    assert sorted((r.s, r.ix, r.item) for r in lists.follow_lists(cells, starts).collect()) == sorted(want)


def test_unbound_prefixes_need_no_policy(spark):
    """uses were shuffled by policy and again by place to find what fixes them."""
    c = Corpus(spark, "/root/testdata/sf0.001")
    uses = resolve.term_uses(c.policies, c.rules, c.constraints)
    told = resolve.unbound_prefixes(uses, c.prefixes, c.profiles, c.terms)
    key = ["doc_id", "path", "slot", "written", "iri"]
    want = resolve.term_findings(uses, c.policies, c.prefixes, c.profiles, c.terms, c.odrl_terms, with_iri=True).where("rule = 'profile.unbound-prefix'").select(*key)
    got = told.where("unbound").select(*key)
    assert want.count() > 0 and told.count() == uses.count() and want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    assert "hashpartitioning(doc_id" not in plan(told) and "hashpartitioning(iri" not in plan(told)


def test_entities_meet_their_lines_in_one_shuffle(spark):
    """lines were gathered by place, joined with entities by place, and gathered again."""
    entities = spark.createDataFrame(
        [(1, 0, "o", "target", 1, "urn:b", "urn:b", None, None), (1, 0, "o", "target", 0, "urn:a", "urn:a", None, None), (1, 0, "o", "target", 2, None, None, None, None), (1, 0, "n", "assignee", 0, None, None, None, None)],
        "doc_id long, policy_ix int, owner string, role string, ord int, written string, iri string, collection string, collection_iri string",
    )
    labels = spark.createDataFrame([(1, "urn:b", "B")], "doc_id long, iri string, label string")
    lines = spark.createDataFrame([(1, 0, "o", "target", 1, 10, "late"), (1, 0, "o", "target", 1, 2, "soon"), (1, 0, "o", "target", 2, 0, "lost"), (1, 0, "x", "target", 0, 0, "none")], "doc_id long, policy_ix int, owner string, role string, ord int, ix int, line string")
    named = conditions.entity_names(entities, labels, lines, ["doc_id", "policy_ix"])
    assert plan(named).count("Exchange hashpartitioning") == 1
    assert sorted((r.owner, r.names, r.refined, r.n_nameless) for r in named.collect()) == [("n", [], False, 1), ("o", ["urn:a", "B where soon; late"], True, 1)]


def test_children_are_told_by_their_numbers(spark):
    paths = [f"c.child[{k}]" for k in (2, 10, 0)] + ["c", "c.child[2].child[11]", "c.child[2].child[9]"]
    got = conditions.condition_lines(spark.createDataFrame([(1, p, p[1:]) for p in paths], "k int, path string, text string"), ["k"])
    assert [r.line for r in got.collect()] == [": .child[0]; .child[2]; .child[2].child[9]; .child[2].child[11]; .child[10]"]


def test_bounds_and_patterns_are_settled_for_each_hint(spark):
    """F7, F8: each constraint worked out anew what its hint's bounds and pattern are."""
    rows = [(1, k, f"p{k}", "l", "eq", "literal", raw, None, None, None, None) for k, raw in enumerate(("5", "x", "50", " 7 ", "1e1", "2020-01-01"))]
    rows += [(1, 9, "p9", "m", "eq", "literal", "٧a", None, None, None, None), (1, 8, "p8", "d", "eq", "literal", "2020-01-01", None, None, None, None), (1, 7, "p7", "d", "eq", "literal", "2021-01-01T10", None, None, None, None)]
    constraints = spark.createDataFrame(rows, "doc_id long, policy_ix int, path string, left_iri string, operator_name string, right_kind string, raw string, value_iri string, datatype string, unit_iri string, value_any string")
    of = [("l", None, "6", "20", None, False), ("m", None, None, None, r"^\d$", False), ("d", None, None, "2020-12-31", None, False)]
    table = spark.createDataFrame(of, "left_iri string, datatype string, lo string, hi string, pattern string, closed boolean")
    none = lambda names: spark.createDataFrame([], names)
    found = hints.hint_findings(constraints, table, none("left_iri string, op string"), none("left_iri string, value string"), none("left_iri string, unit string"), none("doc_id long, policy_ix int"))
    assert sorted((r.path, r.rule) for r in found.collect()) == [(p, "prose.value-not-allowed") for p in ("p0", "p2", "p7", "p9")]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(h_pattern" not in text and "\\p{Nd}" not in text


def test_code_that_the_jvm_never_compiles_is_not_run_as_one_method(spark):
    Corpus(spark, "/none")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 9000)
    Corpus(spark, "/none")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "9000"
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)


def test_reports_find_terms_and_hints_once(spark, monkeypatch):
    """findings of terms and hints were worked out twice, for what is told and for what mends it."""
    written = []
    monkeypatch.setattr(rules, "cut", lambda df, name: written.append(name) or cut(df, name))
    monkeypatch.setattr(report, "report_json", lambda *tables: tables[0])
    rules._reports(Corpus(spark, "/root/testdata/sf0.001"))
    assert written.count("terms") == written.count("hinted") == 1
