"""Streams give what their batch reading gives, whatever the batches are."""

import pytest
from pyspark.sql import functions as F

from clausework.streaming import edits


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("log") / "t")
    rows = spark.range(400).select(
        (F.col("id") % 7).alias("doc_id"), F.col("id").alias("seq"), F.element_at(F.array(*[F.lit(x) for x in ("SetText", "Add", "Remove", "SetIri")]), (F.xxhash64("id") % 4 + 4).cast("int") % 4 + 1).alias("op"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("slot"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"),
        F.when(F.col("id") % 5 == 0, F.floor(F.col("id") / 20)).alias("expect"),
    )
    # Four files by range of seq: four batches.
    rows.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(folder)
    return folder, rows


def test_edit_log(spark, log, tmp_path):
    folder, rows = log
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    q = edits.apply_edits(stream).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.doc_id, r.seq): (r.accepted, r.version, r.value) for r in spark.table("outcomes").collect()}
    want = {}
    for doc in range(7):
        mine = [(r.seq, r.op, r.slot, r.value, r.expect) for r in rows.where(F.col("doc_id") == doc).collect()]
        for seq, ok, version, _, value in edits.reduce_edits(0, {}, mine)[2]:
            want[doc, seq] = (ok, version, value)
    assert got == want


def test_new_urls(spark, log, tmp_path):
    folder, rows = log
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = edits.new_urls(stream, "slot").writeStream.format("memory").queryName("urls").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.slot for r in spark.table("urls").collect()) == ["s0", "s1", "s2"]


def test_only_changed_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (2, 0, "a"), (1, 3, "a")], "doc_id long, seq long, digest string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = edits.changed_reports(stream).writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.doc_id, r.seq) for r in spark.table("changed").collect()) == [(1, 0), (1, 2), (1, 3), (2, 0)]


def test_stale_edit_changes_nothing():
    version, slots, out = edits.reduce_edits(3, {"a": "x"}, [(1, "SetText", "a", "y", 2), (2, "Remove", "b", None, None), (3, "Add", "a", "z", None), (4, "SetIri", "a", "w", 3)])
    assert (version, slots) == (4, {"a": "w"}) and [r[1] for r in out] == [False, False, False, True]
