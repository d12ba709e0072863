"""Near duplicates by MinHash: an inverted join of signature coordinates.

A document is the set of its distinct three-word shingles, and two documents link
when 100 * |intersection| >= 85 * |union|.  The result is each document's
component under those links.

1.  Documents with equal sets are one class.  A class has a signature: under each
    of ``COORDINATES`` random orders of all shingles, its first shingle.  Two sets
    agree in a coordinate with the probability of their Jaccard similarity, so a
    pair that links agrees in ``MATCHES`` coordinates at least but for one time in
    10^8 at the very border (4e-13 at a similarity of 0.9).
2.  Each class posts under its coordinate-value pairs, those that few classes have
    first (one order for all, by a count sketch of fixed size over all classes).
    Two classes that agree in ``MATCHES`` coordinates meet under one of their first
    ``PREFIX`` pairs, so no others are posted.
3.  The classes behind a pair first meet its leader, the one that shares most of
    its own pairs.  Collisions are counted on the signatures, pairs below
    ``MATCHES`` go, and the rest is compared on the full sets.
4.  Pairs behind which more than one component is left are posting lists in blocks
    of bounded size; each block meets each other of its list.  A task merges the
    lists of a query's coordinates, rare ones first, and skips members that can't
    reach ``MATCHES`` with the coordinates that are left.  Two classes are judged
    only at the first pair they share.  What is left open meets once more with
    its texts, and is compared on the full sets until the components are one.

No step makes all pairs of a list as rows, and nothing is capped.  A class is
posted, met and compared by its smallest doc_id's text; texts are read again, not
kept.

Cases: a null or empty text, or one without words, has the empty set and is its
own component; a text of one or two words is one shingle; a very long text is one
set like any other, hashed in pieces; rows that share a doc_id are one document
(each row is returned, links of either count for both); repeated rows each get the
same result; ties (equal sets, equal shares) go to the smallest number; a row
without doc_id links to nothing and has no component; an empty table gives no
rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import cut, small_batches, spent, without
from clausework.llm.components import components, jump, start, step
from clausework.llm.jaccard import CHUNK_COUNTERS, COUNTERS, MOST_PICKED, _classes, _mix, _random, set_key, tokens_of

WORDS, PERCENT = 3, 85
#: Coordinates of a signature, how many of them must agree, and how many are posted.
COORDINATES, MATCHES = 64, 36
PREFIX = COORDINATES - MATCHES + 1
#: Shingles hashed at a time, classes in a block of signatures, shingles in a block of texts.
PIECE, BLOCK_CLASSES, BLOCK_SHINGLES = 4096, 1024, 1 << 16

_SEED = _random(COORDINATES, 1 << 40)[:, None]
_COORDINATE = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)


def signature_of(tokens: np.ndarray) -> np.ndarray:
    """The least of the shingles' hashes under each order, its high half."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(tokens), PIECE):
            least = np.minimum(least, _mix(tokens[k : k + PIECE].view(np.uint64)[None, :] + _SEED).min(1))
    return (least >> np.uint64(32)).astype("<u4")


def pairs_of(signatures: np.ndarray) -> np.ndarray:
    """A number for each coordinate with its value."""
    with np.errstate(over="ignore"):
        return _mix(signatures.astype(np.uint64) | _COORDINATE).view(np.int64)


def _read(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < PERCENT * large or not small:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_key, signature of each row (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch.column(1):
                t = tokens_of(text.as_py(), WORDS)
                sizes.append(len(t))
                keys.append(set_key(t))
                signatures.append(signature_of(t).tobytes() if len(t) else None)
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "set_key", "signature"])

    return docs.mapInArrow(run, "doc_id long, n long, set_key binary, signature binary")


def _rarity(classes: DataFrame):
    """A broadcast byte for each counter: how many classes have the pairs that fall on it, as a logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            if len(batch):
                np.add.at(seen, pairs_of(_read(batch.column(0))).ravel() & (COUNTERS - 1), 1)
        parts = seen.reshape(-1, CHUNK_COUNTERS)
        full = np.flatnonzero(parts.any(1))
        packed = [zlib.compress(parts[k].astype("<u4").tobytes(), 1) for k in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])

    return _classes(classes.select("signature").mapInArrow(run, "chunk int, counts binary"))


def _ranks(signatures: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Each coordinate's place in the order of its class: rare pairs first, then by number."""
    pairs = pairs_of(signatures)
    order = np.lexsort((pairs, rarity[pairs & (COUNTERS - 1)]), axis=1)
    ranks = np.empty(order.shape, np.uint8)
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(COORDINATES, dtype=np.uint8), order.shape), 1)
    return ranks


def _posted(classes: DataFrame, rarity) -> DataFrame:
    """pair, node for the first ``PREFIX`` pairs of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                signatures = _read(batch.column(1))
                row, coordinate = np.nonzero(_ranks(signatures, rarity.value) < PREFIX)
                pairs = pa.array(pairs_of(signatures)[row, coordinate])
                yield pa.RecordBatch.from_arrays([pairs, batch.column(0).take(pa.array(row))], ["pair", "node"])

    return classes.select("node", "signature").mapInArrow(run, "pair long, node long")


def _few(nodes: DataFrame) -> DataFrame:
    """``nodes`` (distinct), to be broadcast only if they are few."""
    nodes = cut(nodes, "nodes")
    return F.broadcast(nodes) if nodes.count() <= MOST_PICKED else nodes


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set_key, text of the given nodes, for each row of the doc_id that stands for it."""
    wanted = cut(classes.join(_few(nodes), "node").select("node", F.col("rep").alias("doc_id"), "set_key"), "wanted")
    return docs.join(F.broadcast(wanted) if wanted.count() <= MOST_PICKED else wanted, "doc_id").select("node", "set_key", "text")


def _set_of(text: str, key: bytes) -> np.ndarray | None:
    """The set of a text, if it is the class's: another row may share the doc_id."""
    t = tokens_of(text, WORDS)
    return t if set_key(t) == key else None


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


EDGES = "a long, b long"


def _star_links(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: collisions are counted first, then the full sets compared.

    ``b`` is the leader, which many pairs have: its side of the joins is never split.
    """

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.select([0, 1]).filter(pa.array((_read(batch.column(2)) == _read(batch.column(3))).sum(1) >= MATCHES))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            kept = []
            for key_a, x, key_b, y in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                y = (key_b.as_py(), y.as_py())
                if y != last:
                    last, last_set = y, _set_of(y[1], y[0])
                own = _set_of(x.as_py(), key_a.as_py())
                kept.append(own is not None and last_set is not None and links(own, last_set))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    pairs = cut(pairs.distinct(), "pairs")
    signed = classes.select("node", "signature").join(_few(_nodes_of(pairs)), "node")
    of = lambda t, x, *cols: t.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    counted = pairs.join(of(signed, "a", "signature"), "a").join(of(signed, "b", "signature"), "b").select("a", "b", "signature_a", "signature_b")
    left = cut(counted.mapInArrow(collide, EDGES), "collided")
    texts = _texts(docs, classes, _nodes_of(left))
    both = left.join(of(texts, "a", "set_key", "text"), "a").join(of(texts, "b", "set_key", "text"), "b").select("a", "b", "set_key_a", "text_a", "set_key_b", "text_b")
    return cut(both.mapInArrow(confirm, EDGES).distinct(), "links")


def _blocks(rows: DataFrame, size, limit: int, *carried: str) -> DataFrame:
    """pair, asking, inside: each block of a list meets each of its blocks once (itself with nothing inside).

    A list is dealt by hash to as many blocks as the sum of ``size`` needs.
    """
    total = rows.groupBy("pair").agg(F.ceil(F.sum(size) / limit).alias("n_blocks"))
    dealt = rows.join(total, "pair").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("n_blocks", F.lit(1))))
    blocks = dealt.groupBy("pair", "n_blocks", "block").agg(F.collect_list(F.struct("node", "n", "label", "data", *carried)).alias("members"))
    blocks = cut(blocks, "blocks")
    alone = blocks.select("pair", F.col("members").alias("asking"), F.lit(None).cast(blocks.schema["members"].dataType).alias("inside"))
    several = blocks.where("n_blocks > 1")
    other = several.select("pair", F.col("block").alias("other"), F.col("members").alias("inside"))
    return alone.unionByName(several.join(other, "pair").where("block < other").select("pair", F.col("members").alias("asking"), "inside"))


class _List:
    """Members of a block as columns."""

    def __init__(self, members: list[dict]) -> None:
        self.members = members
        data = np.frombuffer(b"".join(m["data"] for m in members), np.uint8).reshape(len(members), -1)
        self.signatures = data[:, : 4 * COORDINATES].copy().view("<u4")
        self.ranks = data[:, 4 * COORDINATES :]
        self.n = np.array([m["n"] for m in members], np.int64)
        self.labels = np.array([m["label"] for m in members], np.int64)


def _merged(query: _List, k: int, inside: _List, alive: np.ndarray) -> np.ndarray:
    """Members among ``alive`` that agree with query k in ``MATCHES`` coordinates: its rare ones are merged first, and whoever can't reach the rest is skipped."""
    order = np.argsort(query.ranks[k])
    counts, left = np.zeros(len(alive), np.int64), COORDINATES
    for part in (order[:PREFIX], order[PREFIX : PREFIX + 16], order[PREFIX + 16 :]):
        counts += (inside.signatures[alive[:, None], part] == query.signatures[k, part]).sum(1)
        left -= len(part)
        stay = counts + left >= MATCHES
        alive, counts = alive[stay], counts[stay]
        if not len(alive):
            break
    return alive


def _candidates(pair: int, asking: _List, inside: _List | None) -> Iterator[tuple[int, np.ndarray]]:
    """Each query of ``asking`` with the members of other components to compare it with, whose first common pair is this list's."""
    coordinate = int(np.flatnonzero(pairs_of(asking.signatures[:1])[0] == pair)[0])
    for k in range(len(asking.members)):
        other = asking if inside is None else inside
        n, m = asking.n[k], other.n
        fit = (other.labels != asking.labels[k]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        if inside is None:
            fit[: k + 1] = False
        found = _merged(asking, k, other, np.flatnonzero(fit))
        if len(found):
            common = other.signatures[found] == asking.signatures[k]
            first = np.where(common, asking.ranks[k], COORDINATES).min(1)
            found = found[first == asking.ranks[k, coordinate]]
        if len(found):
            yield k, found


def _opened(met: DataFrame) -> DataFrame:
    """pair, node, n, label: the members that have candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pair, asking, inside in zip(*batch.columns, strict=True):
                pair = pair.as_py()
                asked = _List(asking.as_py())
                others = _List(inside.as_py()) if inside.is_valid else None
                open_ = set()
                for k, found in _candidates(pair, asked, others):
                    open_.add((True, k))
                    open_.update((others is None, int(j)) for j in found)
                for own, k in open_:
                    m = (asked if own else others).members[k]
                    rows.append((pair, m["node"], m["n"], m["label"]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["pair", "node", "n", "label"])

    return met.mapInArrow(run, "pair long, node long, n long, label long").distinct()


def _list_links(met: DataFrame) -> DataFrame:
    """Links (a, b) between components, as many as it takes to join those that any pair of a block joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for pair, asking, inside in zip(*batch.columns, strict=True):
                asked = _List(asking.as_py())
                others = _List(inside.as_py()) if inside.is_valid else None
                joined: dict[int, int] = {}
                sets: dict[int, np.ndarray | None] = {}

                def root(x, joined=joined):
                    while joined.get(x, x) != x:
                        x = joined[x]
                    return x

                def set_of(m, sets=sets):
                    if m["node"] not in sets:
                        found = [t for t in (_set_of(x.decode(), m["set_key"]) for x in m["texts"]) if t is not None]
                        sets[m["node"]] = found[0] if found else None
                    return sets[m["node"]]

                for k, found in _candidates(pair.as_py(), asked, others):
                    own = asked.members[k]
                    for j in found:
                        other = (asked if others is None else others).members[j]
                        x, y = root(own["label"]), root(other["label"])
                        if x != y and (s := set_of(own)) is not None and (t := set_of(other)) is not None and links(s, t):
                            joined[max(x, y)] = min(x, y)
                            a.append(own["node"])
                            b.append(other["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cut(met.mapInArrow(run, EDGES).distinct(), "links")


def _data(classes: DataFrame, nodes: DataFrame, rarity) -> DataFrame:
    """node and its data, signature and ranks, for the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                signatures = _read(batch.column(1))
                ranks = _ranks(signatures, rarity.value)
                packed = [s.tobytes() + r.tobytes() for s, r in zip(signatures, ranks, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "data"])

    return classes.select("node", "signature").join(_few(nodes), "node").mapInArrow(run, "node long, data binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    # 1. Classes of equal sets, with signatures.
    read = cut(_signed(docs), "signed")
    grouped = read.where("set_key is not null and doc_id is not null").groupBy("set_key", "n", "signature").agg(F.min("doc_id").alias("rep"))
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    rarity = _rarity(classes)

    # 2. Postings; pairs that several classes have.
    posted = cut(_posted(classes, rarity), "posted")
    several = posted.groupBy("pair").agg(F.count("*").alias("classes")).where("classes > 1").select("pair")
    shared = cut(posted.join(several, "pair"), "shared")
    spent(posted)
    share = shared.groupBy("node").agg(F.count("*").alias("share"))
    rows = cut(shared.join(share.join(classes.select("node", "n"), "node"), "node"), "rows")
    lead = F.max(F.struct("share", (-F.col("node")).alias("minus"), "n")).alias("lead")
    leaders = rows.groupBy("pair").agg(lead).select("pair", (-F.col("lead.minus")).alias("leader"), F.col("lead.n").alias("leader_n"))
    spent(shared)

    # 3. Every class behind a pair against its leader.
    fits = f"100 * least(n, leader_n) >= {PERCENT} * greatest(n, leader_n)"
    stars = rows.join(leaders, "pair").where(f"node <> leader and {fits}").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    first = _star_links(docs, classes, stars)
    labels = start(first)
    for _ in range(2):  # the leader takes the least number around it, then its classes take the leader's
        labels = cut(jump(step(labels, first)).select("node", "label"), "labels")

    # 4. Lists with several components left, block by block: first signatures, then texts.
    labelled = rows.join(labels, "node", "left").select("pair", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("pair").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("pair")
    rest = cut(labelled.join(mixed, "pair"), "rest")
    spent(rows)
    data = cut(_data(classes, rest.select("node").distinct(), rarity), "data")
    open_ = cut(_opened(_blocks(rest.join(data, "node"), F.lit(1), BLOCK_CLASSES)), "opened")
    texts = _texts(docs, classes, open_.select("node").distinct()).groupBy("node", "set_key").agg(F.collect_set(F.encode("text", "UTF-8")).alias("texts"))
    second = _list_links(_blocks(open_.join(data, "node").join(texts, "node"), F.col("n"), BLOCK_SHINGLES, "set_key", "texts"))
    spent(rest, open_, data)

    # Rows that share a doc_id are one document.
    keyed = classes.select("set_key", "node", "rep")
    twice = read.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    twice = cut(read.join(twice, "doc_id").join(keyed, "set_key", "left").select("doc_id", "node"), "twice")
    bound = twice.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("doc_id", "a")
    same = twice.join(bound, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))

    # Components, first of classes, then of documents.
    edges = cut(first.unionByName(second).unionByName(same).distinct(), "edges")
    found = components(edges)
    least = found.join(keyed, "node").groupBy("label").agg(F.min("rep").alias("component"))
    of_class = keyed.join(found.join(least, "label").select("node", "component"), "node", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    result = read.select("doc_id", "n", "set_key").join(of_class, "set_key", "left")
    if not twice.isEmpty():  # also where one of the rows is empty
        joined = result.join(twice.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.min("component").alias("of_rows"))
        result = result.join(joined, "doc_id", "left").withColumn("component", F.coalesce("of_rows", "component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; rows without doc_id stay."""
    return without(docs, near_duplicates(docs).where("doc_id <> component_id").select("doc_id"))
