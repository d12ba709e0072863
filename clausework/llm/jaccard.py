"""Near duplicates: an exact Jaccard join through a token-group matrix.

A document is the set of its distinct five-word shingles, and two documents link
when 100 * |intersection| >= 80 * |union|.  The result is each document's
component under those links.

1.  Documents with equal sets are one class; its smallest doc_id stands for it.
2.  Tokens (shingles as 64-bit hashes) have one order for all documents: rare ones
    first, by a count sketch of fixed size over all tokens of all documents, then
    by hash.  Any order is exact; this one keeps passages that many documents
    share out of most prefixes.
3.  All tokens that two sets share stand at or after the first one they share, so
    a token at place p of a set of n allows partners of up to (5 n - 9 p) / 4
    tokens only.  Tokens that allow none are not shuffled (prefix), and a pair
    meets at a token only if either size is within what the other allows.
4.  The documents behind a token first meet the token's leader, the one that
    shares most of its tokens with others: a large family of near copies links to
    its original in as many comparisons as it has members.  Linked documents are
    a group of similar documents.
5.  The token-group matrix has a row for each token and group, with the sizes its
    members have and allow.  A document that shares a token with another group
    within those sizes is a query to it.  Groups are stored in blocks of bounded
    size, first with the union of their members' token counts in ``BUCKETS``
    buckets: what a query can share with any member is at most the sum of the
    smaller counts, so only groups and members where this bound reaches
    ceil(0.8 n) are opened.  What is left is compared token by token.

No step makes all pairs of a group, and nothing is capped.

Cases: a null or empty text, or one without words, has the empty set and is its
own component; a text of one to four words is one shingle; a very long text is
one set like any other; rows that share a doc_id are one document (each row is
returned, links of either count for both); repeated rows each get the same
result; ties (equal sets, equal shares) go to the smallest doc_id; a row without
doc_id links to nothing and has no component; an empty table gives no rows;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import cut, small_batches, spent, without
from clausework.llm.components import components, jump, start, step

WORDS = 5
#: Counters of the sketch that orders tokens, and how many of them travel in a row.
COUNTERS, CHUNK_COUNTERS = 1 << 22, 1 << 14
#: Bits of the filter that tells tokens of several documents from most others; its
#: size is fixed, and what it lets through is joined exactly.
FILTER_CHUNKS, CHUNK_BITS = 64, 1 << 20
#: Up to this many document ids are broadcast to pick their rows; more are joined.
MOST_PICKED = 1 << 20
#: Tokens in a block of a group or of queries.
BLOCK_TOKENS = 1 << 16
#: Buckets of the counts that bound an overlap.
BUCKETS = 512


#: Odd factors, one for each place in a shingle.
_FACTOR = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result hangs on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers, the outputs of splitmix64."""
    with np.errstate(over="ignore"):
        return _mix(np.arange(seed, seed + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# 0x20 and 0x09-0x0D part words; A-Z count as a-z.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = _random(256, 1)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B]
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as the longest text has bytes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def tokens_of(text: str | None, n_words: int = WORDS) -> np.ndarray:
    """The set of a text: sorted distinct hashes of its shingles.

    A word's hash is a polynomial in its bytes modulo 2**64, mixed; all words of a
    text are cut out of one running sum.
    """
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64)
    up, down = _powers.get(len(raw))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[raw] * up)])
        h = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        width = min(n_words, len(h))
        total = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            total += h[k : len(h) - width + 1 + k] * _FACTOR[k % len(_FACTOR)]
        tokens = np.sort(_mix(total).view(np.int64))
    return tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])]


def set_key(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def needed(n: int) -> int:
    """Tokens that a set of n must share with any set that links to it."""
    return (4 * n + 4) // 5


def links(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 5 * small < 4 * large or not small:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def allowed(n, place):
    """The largest partner that a set of n can link to when the first shared token stands at ``place`` (from 0).

    What they share is at most n - place, and 9 |intersection| >= 4 (n + m).
    """
    return (5 * n - 9 * place) // 4


def _prefix(t: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the order: those that allow any partner."""
    order = np.argsort(classes[t & (COUNTERS - 1)], kind="stable")  # t is sorted by hash
    return t[order[: len(t) - needed(len(t)) + 1]] if len(t) else t


SETS = "doc_id long, n long, set_key binary, chunk int, counts binary"


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_key of each row (doc_id, text), and each task's token counts by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column(1):
                t = tokens_of(text.as_py())
                sizes.append(len(t))
                keys.append(set_key(t))
                np.add.at(seen, t & (COUNTERS - 1), 1)
            yield rows(batch.column(0), sizes, keys, pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary()))
        parts = seen.reshape(-1, CHUNK_COUNTERS)
        full = np.flatnonzero(parts.any(1))
        packed = [zlib.compress(parts[k].astype("<u4").tobytes(), 1) for k in full]
        yield rows(pa.nulls(len(full), pa.int64()), [None] * len(full), [None] * len(full), pa.array(full, pa.int32()), pa.array(packed, pa.binary()))

    def rows(ids, sizes, keys, chunks, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), chunks, counts], ["doc_id", "n", "set_key", "chunk", "counts"])

    return docs.mapInArrow(run, SETS)


def _classes(counted: DataFrame):
    """A broadcast byte for each counter: four times the logarithm of its sum over all tasks, from rows (chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(counts.as_py()), "<u4")
                sums[chunk] = sums[chunk] + part if chunk in sums else part.astype(np.int64)
        packed = [np.floor(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "classes"])

    found = counted.repartition(COUNTERS // CHUNK_COUNTERS, "chunk").mapInArrow(run, "chunk int, classes binary").collect()
    classes = np.zeros((COUNTERS // CHUNK_COUNTERS, CHUNK_COUNTERS), np.uint8)
    for r in found:
        classes[r.chunk] = np.frombuffer(r.classes, np.uint8)
    return counted.sparkSession.sparkContext.broadcast(classes.reshape(-1))


PREFIX = "doc_id long, n long, prefix array<long>"


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), pa.int64()))


def _prefixes(docs: DataFrame, classes) -> DataFrame:
    """doc_id, n and the prefix, in order, of each row (doc_id, text) with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, parts = [], []
            for text in batch.column(1):
                t = tokens_of(text.as_py())
                sizes.append(len(t))
                parts.append(_prefix(t, classes.value))
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _lists(parts)], ["doc_id", "n", "prefix"])
            yield made.filter(pa.array(np.array(sizes) > 0))

    return docs.mapInArrow(run, PREFIX)


def _filter_of(tokens: DataFrame):
    """A broadcast bit for the low bits of each token; a chunk of bits is set in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(t % FILTER_CHUNKS):
                bits = chunks.setdefault(int(c), np.zeros(CHUNK_BITS, bool))
                bits[(t[t % FILTER_CHUNKS == c] // FILTER_CHUNKS) % CHUNK_BITS] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(chunks), pa.int64()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in chunks.values()], pa.binary())], ["chunk", "bits"]
        )

    dealt = tokens.repartition(FILTER_CHUNKS, F.pmod("token", F.lit(FILTER_CHUNKS)))
    found = dealt.mapInArrow(run, "chunk long, bits binary").collect()
    bits = np.zeros((FILTER_CHUNKS, CHUNK_BITS // 8), np.uint8)
    for r in found:
        bits[r.chunk] |= np.frombuffer(r.bits, np.uint8)
    return tokens.sparkSession.sparkContext.broadcast(bits)


def _rows(prefixes: DataFrame, bits) -> DataFrame:
    """token, doc_id, n, allowed, share for the tokens of prefixes that the filter lets through; share: how many of a document's they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), lengths)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            n = batch.column(1).to_numpy(zero_copy_only=False)[row]
            most = allowed(n, place)
            at = (tokens // FILTER_CHUNKS) % CHUNK_BITS
            keep = ((bits.value[tokens % FILTER_CHUNKS, at >> 3] >> (at & 7)) & 1 == 1) & (5 * most >= 4 * n)
            share = np.bincount(row[keep], minlength=len(batch))
            row = row[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[keep], pa.int64()), batch.column(0).take(pa.array(row)), pa.array(n[keep], pa.int64()), pa.array(most[keep], pa.int64()), pa.array(share[row], pa.int64())],
                ["token", "doc_id", "n", "allowed", "share"],
            )

    return prefixes.select("doc_id", "n", "prefix").mapInArrow(run, "token long, doc_id long, n long, allowed long, share long")


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the given ids (doc_id, distinct), which are broadcast only if they are few."""
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_PICKED else ids, "doc_id", "left_semi")


def _counts(t: np.ndarray) -> bytes:
    """The set's size, then how many of its tokens are in each bucket."""
    counts = np.bincount(t & (BUCKETS - 1), minlength=BUCKETS)
    return np.concatenate([[len(t)], counts]).astype("<u2" if len(t) < 1 << 16 else "<u4").tobytes()


def _read_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * (BUCKETS + 1) else "<u4").astype(np.int64)


def _count_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and its bucket counts for the given ids; repeated ids have one row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_counts(tokens_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "data"])

    return _picked(docs, ids).mapInArrow(run, "doc_id long, data binary")


def _blocks(rows: DataFrame, data: DataFrame) -> DataFrame:
    """grp, block and the block's documents with their data, from rows (doc_id, grp, n).

    A group is dealt by hash to as many blocks as its tokens need, so a list is
    bounded whatever the group's size (but for one document larger than that).
    The blocks are dealt on the small rows; the data are moved twice.
    """
    total = rows.groupBy("grp").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("n_blocks"))
    dealt = rows.join(total, "grp").select("doc_id", "grp", F.pmod(F.xxhash64("doc_id"), F.greatest("n_blocks", F.lit(1))).alias("block"))
    return dealt.join(data, "doc_id").groupBy("grp", "block").agg(F.collect_list(F.struct("doc_id", "data")).alias("docs"))


def _near(asking: list[dict], inside: list[dict]) -> tuple[list, list]:
    """Queries and members (id, size) whose bucket counts allow a link with any of the others; a block stays closed where its union does not."""
    group = np.stack([_read_counts(m["data"]) for m in inside])
    union = group[:, 1:].max(0)
    needs = (4 * group[:, 0] + 4) // 5
    open_ = np.zeros(len(inside), bool)
    queries = []
    for q in asking:
        own = _read_counts(q["data"])
        least = needed(int(own[0]))
        if np.minimum(own[1:], union).sum() < least:
            continue
        hit = np.minimum(own[1:], group[:, 1:]).sum(1) >= np.maximum(least, needs)
        if hit.any():
            queries.append((q["doc_id"], int(own[0])))
            open_ |= hit
    return queries, [(inside[k]["doc_id"], int(group[k, 0])) for k in np.flatnonzero(open_)]


def _met(queries: DataFrame, members: DataFrame, data: DataFrame) -> DataFrame:
    """grp, asking, inside: each block of a group meets each block of its queries (both doc_id, grp, n) once."""
    index = _blocks(members, data).select("grp", F.col("docs").alias("inside"))
    asked = _blocks(queries, data).select("grp", F.col("docs").alias("asking"))
    return asked.join(index, "grp").select("grp", "asking", "inside")


def open_groups(queries: DataFrame, members: DataFrame, counts: DataFrame) -> DataFrame:
    """grp, doc_id, n, asks: the queries and the members of groups that the counts leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                grp, (asking, inside) = batch.column(0)[k].as_py(), _near(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                rows += [(grp, *x, True) for x in asking] + [(grp, *x, False) for x in inside]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["grp", "doc_id", "n", "asks"])

    return _met(queries, members, counts).mapInArrow(run, "grp long, doc_id long, n long, asks boolean").distinct()


def group_links(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """Links (a, b) of queries with open groups, one for each query and block: a group's members are linked among themselves already."""
    opened = cut(opened, "opened")
    texts = _picked(docs, cut(opened.select("doc_id").distinct(), "ids")).select("doc_id", F.encode("text", "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for asking, inside in zip(batch.column(1), batch.column(2), strict=True):
                group = [(m["doc_id"], tokens_of(m["data"].decode())) for m in inside.as_py()]
                for q in asking.as_py():
                    t = tokens_of(q["data"].decode())
                    other = next((i for i, x in group if i != q["doc_id"] and links(t, x)), None)
                    if other is not None:
                        a.append(min(other, q["doc_id"]))
                        b.append(max(other, q["doc_id"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = _met(opened.where("asks").select("doc_id", "grp", "n"), opened.where("not asks").select("doc_id", "grp", "n"), texts)
    return cut(met.mapInArrow(run, "a long, b long").distinct(), "links")


def _pair_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, smaller id first.

    The texts travel, not the sets: they are smaller once compressed.  A document
    in many pairs is on the side of the join that is not split.
    """
    pairs = cut(pairs.distinct(), "pairs")
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = _picked(docs, ids)
    of = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), batch.column(3), strict=True):
                y = y.as_py()
                if y != last:
                    last, last_set = y, tokens_of(y)
                if links(tokens_of(x.as_py()), last_set):
                    a.append(min(i, j))
                    b.append(max(i, j))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut(joined.mapInArrow(run, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    return _joined(docs)[0]


def _joined(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``near_duplicates`` and the written tables that it reads."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    # 1. Classes of equal sets, and the order of tokens.
    read = cut(_sets(docs), "sets")
    sets = read.where("chunk is null").select("doc_id", "n", "set_key")
    classes = cut(
        sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    extra = sets.join(classes.where("copies > 1"), "set_key").where("doc_id <> rep").select("doc_id")
    # A doc_id in several rows may stand for one class and be a copy in another: it stays.
    extra = extra.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    order = _classes(read.where("chunk is not null").select("chunk", "counts"))

    # 2. Prefixes; tokens of two documents at least, and their documents.
    prefixes = cut(without(_prefixes(docs.where("doc_id is not null"), order), extra), "prefixes")
    several = cut(prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "several")
    rows = cut(_rows(prefixes, _filter_of(several)).join(several, "token"), "rows")
    spent(prefixes, several)
    lead = F.max(F.struct("share", (-F.col("doc_id")).alias("minus"), "n", "allowed")).alias("lead")
    shared = (
        rows.groupBy("token")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), lead)
        .where("least <> most")
        .select("token", (-F.col("lead.minus")).alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.allowed").alias("leader_allowed"))
    )
    met = cut(rows.join(shared, "token").select("token", "doc_id", "n", "allowed", "leader", "leader_n", "leader_allowed"), "met")
    spent(rows)

    # 3. Every document behind a token against the token's leader.
    fits = "5 * least(n, leader_n) >= 4 * greatest(n, leader_n) and n <= leader_allowed and leader_n <= allowed"
    stars = met.where(f"doc_id <> leader and {fits}")
    first = _pair_links(docs, stars.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))
    labels = start(first)
    for _ in range(2):  # the leader takes the least id around it, then its documents take the leader's
        labels = cut(jump(step(labels, first)).select("node", "label"), "labels")

    # 4. The matrix of tokens and groups; documents that meet a group other than their own.
    grouped = met.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "token", "doc_id", "n", "allowed", F.coalesce("label", "doc_id").alias("grp")
    )
    mixed = grouped.groupBy("token").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("token")
    rest = cut(grouped.join(mixed, "token"), "rest")
    spent(met)
    matrix = rest.groupBy("token", "grp").agg(F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.max("allowed").alias("most_allowed"))
    asks = (
        rest.withColumnRenamed("grp", "own")
        .join(matrix, "token")
        .where("grp < own and 5 * n_most >= 4 * n and n_least <= allowed and n <= most_allowed")
        .select("doc_id", "grp", "n")
        .distinct()
    )
    asks = cut(asks, "asks")
    members = cut(rest.select("doc_id", "grp", "n").distinct().join(asks.select("grp").distinct(), "grp", "left_semi"), "members")
    spent(rest)
    ids = cut(asks.select("doc_id").unionByName(members.select("doc_id")).distinct(), "ids")
    counts = cut(_count_rows(docs, ids), "counts")
    second = group_links(docs, open_groups(asks, members, counts))
    spent(asks, members, ids, counts)

    # Components, first of classes, then of documents.
    edges = cut(first.unionByName(second).distinct(), "edges")
    found = components(edges)
    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("component"))
    result = sets.select("doc_id", "n", "set_key").join(of_class, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return result.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))), [read, classes]


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id."""
    result, tables = _joined(docs)
    gone = cut(result.where("doc_id <> component_id").select("doc_id"), "copies")
    spent(*tables)
    return without(docs, gone)
