"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item gives windows of ``WINDOW`` consecutive words (an item of
fewer words is one window).  A window occurs in a document only if all of its
words do, so with the words of a window ordered by their rarity over the
documents, a prefix of one word is the whole necessary prefix: the documents'
words are joined with that rarest word only.  The word's place in the window
gives the positional bound (where the window would have to start), the length
bound drops starts that do not leave room for it, and what is left is verified
word by word.

The benchmark is held in the workers in blocks of at most ``BLOCK_BYTES`` of
text, measured before anything is collected: its words as numbers end to end, and
for each window where it begins, whose it is and where its rarest word stands, in
arrays sorted by that word.  A full block takes about ten times its text in a
worker.  One block is one pass over the documents; more blocks are more passes
whose hits are merged by document.

Cases: a null or empty text has no words, no hits and is not contaminated; an
item without words has no window; a very long text is read whole; repeated rows
each get their own result, also where they share a doc_id or have none; items
that repeat a text count each; of words that are equally rare the first in byte
order counts; an empty table of documents gives no rows, an empty benchmark no
hits; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import cut, small_batches, text_digest, without_rows

WINDOW = 13
#: Benchmark text that a worker holds at once.
BLOCK_BYTES = 8 << 20

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered: 0-9, a-z and
# whatever is not ASCII.  On UTF-8 bytes that is a table: other bytes become a
# space, and the words are what stands between spaces.
_TO_WORD = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_WORD).split() if text else []


class Windows:
    """The windows of one block, by their rarest word."""

    def __init__(self, items: list[tuple[str, str]], frequency: dict[bytes, int], window: int = WINDOW):
        # Words are numbered from the rarest on; a number is a rank.
        texts = [(item_id, words) for item_id, text in items if (words := words_of(text))]
        ordered = sorted({w for _, words in texts for w in words}, key=lambda w: (frequency.get(w, 0), w))
        number = {w: i for i, w in enumerate(ordered)}
        known = sum(frequency.get(w, 0) == 0 for w in ordered)  # numbers below are of words that no document has
        self.number = {w: i for w, i in number.items() if i >= known}
        self.items = [item_id for item_id, _ in texts]
        parts = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for _, words in texts]
        self.words = np.concatenate([*parts, np.empty(0, np.int32)])
        begin, size, owner, place = [], [], [], []
        at = 0
        for k, part in enumerate(parts):
            n = min(window, len(part))
            spots = np.lib.stride_tricks.sliding_window_view(part, n).argmin(1)
            begin.append(np.arange(at, at + len(spots), dtype=np.int64))
            size.append(np.full(len(spots), n, np.int32))
            owner.append(np.full(len(spots), k, np.int32))
            place.append(spots.astype(np.int32))
            at += len(part)
        join = lambda xs, kind: np.concatenate([*xs, np.empty(0, kind)])
        begin, size, owner, place = join(begin, np.int64), join(size, np.int32), join(owner, np.int32), join(place, np.int32)
        rarest = self.words[begin + place] if len(begin) else np.empty(0, np.int32)
        order = np.argsort(rarest, kind="stable")[int((rarest < known).sum()) :]  # a word that no document has: the window occurs nowhere
        self.begin, self.size, self.owner, self.place = begin[order], size[order], owner[order], place[order]
        #: Where the windows of each rarest word begin in these arrays.
        self.first = np.searchsorted(rarest[order], np.arange(len(ordered) + 1))
        self.keys = {ordered[i] for i in np.unique(rarest[order])}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words that an occurrence covers, and the items that occur."""
        spans, items = set(), set()
        spots = [i for i, w in enumerate(words) if w in self.keys]
        if not spots:
            return [], items
        get = self.number.get
        text = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        # All windows of all rare words at once: where they would begin, then their ends, then word by word.
        low = self.first[text[spots]]
        many = self.first[text[spots] + 1] - low
        window = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        start = np.repeat(spots, many) - self.place[window]
        fits = (start >= 0) & (start + self.size[window] <= len(text))
        start, window = start[fits], window[fits]
        begin, n = self.begin[window], self.size[window]
        same = (text[start] == self.words[begin]) & (text[start + n - 1] == self.words[begin + n - 1])
        for k in np.flatnonzero(same).tolist():
            a, b, m = int(start[k]), int(begin[k]), int(n[k])
            if np.array_equal(text[a : a + m], self.words[b : b + m]):
                spans.add((a, a + m))
                items.add(self.items[self.owner[window[k]]])
        return list(spans), items


def covered(spans: list[tuple[int, int]]) -> int:
    n, end = 0, 0
    for a, b in sorted(spans):
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


def verdict(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple[int, int, int, str, bool]:
    n_hit = covered(spans)
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items with text, in blocks of about ``block_bytes`` at most."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def _frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each benchmark word is; as many rows as the block has words."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(known.value.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
        )

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def _windows(docs: DataFrame, items: list[tuple[str, str]], window: int):
    vocabulary = {w for _, text in items for w in words_of(text)}
    frequency = _frequency(docs, vocabulary) if vocabulary else {}
    return docs.sparkSession.sparkContext.broadcast(Windows(items, frequency, window))


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _one_block(docs: DataFrame, windows, schema: str, finish) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = []
            for text in texts:
                words = words_of(text.as_py())
                found.append((len(words), *windows.value.hits(words)))
            yield finish(batch, found)

    return docs.mapInArrow(run, schema)


def _hit_rows(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    keep = [i for i, (_, spans, _) in enumerate(found) if spans]
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(keep, pa.int64())),
            pa.array([hashlib.sha256((batch.column(1)[i].as_py() or "").encode()).digest() for i in keep], pa.binary()),
            pa.array([[{"a": a, "b": b} for a, b in found[i][1]] for i in keep], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
            pa.array([sorted(found[i][2]) for i in keep], pa.list_(pa.string())),
        ],
        ["doc_id", "text_key", "spans", "items"],
    )


def _all_blocks(docs: DataFrame, blocks: Iterable[list[tuple[str, str]]], window: int) -> DataFrame:
    """doc_id, text_key, n_words, spans, items for each row of ``docs`` (doc_id, text), a pass for each block."""
    hit_schema = "doc_id long, text_key binary, spans array<struct<a:long,b:long>>, items array<string>"
    hits = None
    for items in blocks:  # the generator collects a block at a time
        part = cut(_one_block(docs, _windows(docs, items, window), hit_schema, _hit_rows), "hits")
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy("doc_id", "text_key").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()), pa.array([len(words_of(t)) for t in texts], pa.int64())],
                ["doc_id", "text_key", "n_words"],
            )

    counted = docs.mapInArrow(count, "doc_id long, text_key binary, n_words long").alias("d")
    return counted.join(
        merged.alias("m"), (F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))) & (F.col("d.text_key") == F.col("m.text_key")), "left"
    ).select("d.doc_id", "d.text_key", "d.n_words", "m.spans", "m.items")


def _found(batch: pa.RecordBatch) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """What ``verdict`` takes, of each row of ``_all_blocks``."""
    return [(r["n_words"], [(s["a"], s["b"]) for s in r["spans"] or []], set(r["items"] or [])) for r in batch.to_pylist()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): words, hit words, items, verdict.

    ``benchmark`` has item_id and text.  A document is contaminated when at
    least a twentieth of its words, and one at least, are hit.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        rows = [verdict(*x) for x in found]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    if second is None:
        return _one_block(docs, _windows(docs, first, window), RESULT, finish)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield finish(batch, _found(batch))

    return _all_blocks(docs, chain([first, second], blocks), window).drop("text_key").mapInArrow(judge, RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    small_batches(docs.sparkSession)
    blocks = list(_block_count(benchmark, block_bytes))
    if len(blocks) == 1:
        items = next(_blocks(benchmark, block_bytes))

        def keep(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
            return batch.filter(pa.array([not verdict(*x)[4] for x in found], pa.bool_()))

        return _one_block(docs, _windows(docs, items, window), docs.schema, keep)

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = pa.array([verdict(*x)[4] for x in _found(batch)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "key"]).filter(gone)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = _all_blocks(keyed, _blocks(benchmark, block_bytes), window).where("spans is not null").mapInArrow(bad, "doc_id long, key binary")
    return without_rows(docs, gone, text_digest(docs["text"]))


def _block_count(benchmark: DataFrame, block_bytes: int) -> range:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return range(-(-size // block_bytes) or 1)
