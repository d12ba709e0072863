"""What is written is what was read."""

from clausework.sources import flatten, sinks


def test_documents_come_back(spark):
    texts = ['{"b": 5.0, "a": [1e3, {"c": null, "é": "x\\"y"}], "t": true, "e": {}, "l": []}', "[1, [2, [3]]]", '"only text"', "not json"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in sinks.rebuild_documents(flatten.flatten(docs)).collect()}
    assert got == {0: '{"b": 5.0, "a": [1e3, {"c": null, "é": "x\\"y"}], "t": true, "e": {}, "l": []}', 1: texts[1], 2: texts[2], 3: None}


def test_reports_and_catalog(spark, tmp_path):
    sinks.write_reports(spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2}')], "doc_id long, report string"), str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"a": 1}', '{"a": 2}']
    sinks.write_catalog(spark.createDataFrame([("s", "n", "T | t", "complete", 3)], "source string, name string, title string, status string, n_features int"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first().row == "| T / t | complete | 3 |"
