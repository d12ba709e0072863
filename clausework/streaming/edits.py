"""The edit log and the validation of policies as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausework.operators.rewrite import apply_edit

#: Events of the log: doc_id, seq, op, slot, value, expect (number of edits the writer has seen, or null).
STATE = "version long, slots map<string,string>"
OUT = "doc_id long, seq long, accepted boolean, version long, slot string, value string"


def reduce_edits(version: int, slots: dict[str, str], edits: list[tuple]) -> tuple[int, dict[str, str], list[tuple]]:
    """Apply edits (seq, op, slot, value, expect) in order to one document, as ``apply_edit`` does.

    Returns version, slots and one line for each edit.
    """
    slots = dict(slots)
    out = []
    for seq, op, slot, value, expect in sorted(edits, key=lambda e: e[0]):
        ok = apply_edit(version, slots, op, slot, value, expect)
        version += ok
        out.append((seq, ok, version, slot, slots.get(slot)))
    return version, slots, out


def _none(x: object) -> object:
    return None if pd.isna(x) else x


def apply_edits(log: DataFrame) -> DataFrame:
    """A stream (or table) of edits becomes one of outcomes; the state is the document: its version and slots.

    The state of a document grows with its slots, never with its edits.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, slots = state.get if state.exists else (0, {})
        edits = [(int(r.seq), r.op, r.slot, _none(r.value), None if pd.isna(r.expect) else int(r.expect)) for batch in batches for r in batch.itertuples()]
        version, slots, rows = reduce_edits(version, dict(slots or {}), edits)
        state.update((version, slots))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["doc_id", "seq", "accepted", "version", "slot", "value"])

    return log.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def new_urls(urls: DataFrame, column: str = "url", time: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Each url of a stream once.  With an event time, what is older than ``lateness`` is forgotten."""
    if time is None:
        return urls.select(column).dropDuplicates([column])
    return urls.withWatermark(time, lateness).dropDuplicatesWithinWatermark([column])


def changed_reports(findings: DataFrame) -> DataFrame:
    """A stream of reports (doc_id, seq, digest) without those equal to the document's last one.

    ``digest`` stands for verdict and set of fingerprints; wording and order don't count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        told = []
        for r in sorted((r for batch in batches for r in batch.itertuples()), key=lambda r: r.seq):
            if r.digest != last:
                last = r.digest
                told.append((key[0], r.seq, last))
        state.update((last,))
        yield pd.DataFrame(told, columns=["doc_id", "seq", "digest"])

    return findings.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, seq long, digest string", "last string", "append", GroupStateTimeout.NoTimeout)


def report_digest(findings: DataFrame, key: list[str]) -> DataFrame:
    """key, digest of the set of (rule, path, severity) of a document's findings."""
    each = F.concat_ws("|", "rule", "path", "severity")
    return findings.groupBy(*key).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(each)), ";"), 256).alias("digest"))
