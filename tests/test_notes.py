"""Notes of policies on literal tables."""

from types import SimpleNamespace

from clausework.jobs import readings


def test_notes_expand_compact_parents(spark):
    schema = "doc_id long, policy_ix int, uid string, profile string, conflict string"
    c = SimpleNamespace(
        policies=spark.createDataFrame([(2, 1, "urn:policy:1", None, None), (2, 5, "u5", None, None)], schema),
        inherits=spark.createDataFrame([(2, 5, "pol:1")], "doc_id long, policy_ix int, parent string"),
        rules=spark.createDataFrame([(2, 1)], "doc_id long, policy_ix int"),
        prefixes=spark.createDataFrame([(2, "pol", "urn:policy:")], "doc_id long, prefix string, namespace string"),
    )
    assert [r.note for r in readings._notes(c).collect()] == ["Inherits the rules of pol:1."]
