"""Reports, catalogs and documents written out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON report a line (doc_id, report), in files by the tasks that made them."""
    reports.select(F.col("report").alias("value")).write.text(path)


def write_catalog(entries: DataFrame, path: str) -> None:
    """Entries (source, name, title, status, n_features) as Parquet by source, with a table row of markdown for each."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.replace("title", F.lit("|"), F.lit("/")), "status", F.col("n_features").cast("string")), F.lit(" |"))
    entries.withColumn("row", row).write.partitionBy("source").parquet(path)


def rebuild_documents(rows: DataFrame) -> DataFrame:
    """doc_id, text from flattened rows: objects and lists in their order, numbers as they were written.

    The rows of one document meet in one task; a document is as large as its text.
    """
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("depth", "parent", "pos", "path", "key", "kind", "value"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_text(r.as_py()) for r in batch.column(1)], pa.string())], ["doc_id", "text"])

    return listed.mapInArrow(run, "doc_id long, text string")


def _text(rows: list[dict]) -> str | None:
    """JSON text of one document, built from the deepest rows up."""
    below: dict[str, list[tuple[int, str | None, str]]] = {}
    for r in sorted(rows, key=lambda r: (-r["depth"], r["pos"])):
        inside = below.get(r["path"], [])
        if r["kind"] == "error":
            return None
        if r["kind"] == "object":
            text = "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {t}" for _, k, t in sorted(inside)) + "}"
        elif r["kind"] == "list":
            text = "[" + ", ".join(t for _, _, t in sorted(inside, key=lambda x: x[0])) + "]"
        elif r["kind"] == "string":
            text = json.dumps(r["value"], ensure_ascii=False)
        else:
            text = r["value"] if r["value"] is not None else "null"
        if r["parent"] is None:
            return text
        below.setdefault(r["parent"], []).append((r["pos"], r["key"], text))
    return None
