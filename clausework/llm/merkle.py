"""Merkle manifest of a dataset: trees of hashes whose parents keep hash states.

Each row is a leaf, each language a tree over its leaves in the order of doc_id,
and the trees' roots are the leaves of one more tree.  A parent is the hash of its
children's digests (as hex text), one after another.  While a parent is made, a
copy of the running hash state is kept before each child slot.  To fold a changed
leaf into the root, each parent on its way resumes the state kept before the slot
and takes the replacement and what stands right of it; what stands left is in the
state already.

1.  Rows are numbered in their language's order by a range sort of (lang, doc_id,
    leaf): partition sizes are added up, so no task holds a language.
2.  Trees are cut into blocks of ``WIDTH ** levels`` leaves.  A task makes one
    block; the roots of blocks are the leaves of the next tier, a 4096th of them.
3.  Way back, tier by tier: each block root gets its path to the root, a left and
    a right text a level.
4.  A task takes the leaves of one block and the block's one path, makes the block
    with its states, and folds every leaf, resuming states in the block and above.

Cases: a null field stands as ``-``; a null language is a tree of its own and
comes first; a null doc_id sorts first; rows that share a doc_id are leaves each,
in the order of their digests; repeated rows have equal leaves, so it doesn't
matter which comes first, and they may be spread over tasks; a null or empty text
and a very long one count as they are; a language of one row is its own subroot,
a single language its own root; an empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.llm.common import MOST_KEYS, cut, spent

#: Children of a parent, and levels of a block.
WIDTH, BLOCK_LEVELS = 2, 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(fields: list[Column]) -> Column:
    """Hex digest of fields, each ``-`` if null, else its bytes in UTF-8 after their count and a colon."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def height_of(n: int) -> int:
    """Levels over n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


class Block:
    """Nodes of consecutive leaves by level and, for each parent, the hash states before its child slots."""

    def __init__(self, leaves: list[bytes], height: int) -> None:
        self.levels, self.states = [leaves], []
        for _ in range(height):
            below, above, states = self.levels[-1], [], []
            for first in range(0, len(below), WIDTH):
                running, before = sha256(), []
                for child in below[first : first + WIDTH]:
                    before.append(running.copy())
                    running.update(child)
                states.append(before)
                above.append(running.hexdigest().encode())
            self.levels.append(above)
            self.states.append(states)

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, place: int) -> list[tuple[bytes, bytes]]:
        """What stands left and right of a leaf and of each of its ancestors, below their parents."""
        found = []
        for nodes in self.levels[:-1]:
            first = place - place % WIDTH
            found.append((b"".join(nodes[first:place]), b"".join(nodes[place + 1 : first + WIDTH])))
            place //= WIDTH
        return found

    def fold(self, place: int, node: bytes) -> bytes:
        """The block's root with ``node`` as the leaf at ``place``."""
        for nodes, states in zip(self.levels, self.states, strict=False):
            parent, slot = divmod(place, WIDTH)
            resumed = states[parent][slot].copy()
            resumed.update(node)
            for right in nodes[place + 1 : (parent + 1) * WIDTH]:
                resumed.update(right)
            node, place = resumed.hexdigest().encode(), parent
        return node


class Above:
    """The way from a block's root to the root of all, with the state before each slot on it."""

    def __init__(self, path: list[tuple[bytes, bytes]]) -> None:
        self.steps = [(sha256(left), right) for left, right in path]
        self.siblings = b"".join(left + right for left, right in path)
        self.known: dict[bytes, bytes] = {}

    def fold(self, start: bytes) -> bytes:
        if start not in self.known:
            node = start
            for state, right in self.steps:
                resumed = state.copy()
                resumed.update(node)
                resumed.update(right)
                node = resumed.hexdigest().encode()
            self.known[start] = node
        return self.known[start]


def _numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with tree (a number that ascends with ``group``), ix (from 0 in the tree) and n (the tree's size), and the table they are read from.

    The sort is dealt by ranges of (group, order, input row), so equal keys are spread too.  ``rows`` is a written table.
    """
    keys = [*group, *order, "__row"]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = cut(dealt.drop("__row").withColumn("__at", F.monotonically_increasing_id()), "placed")
    placed = written.withColumn("__part", F.shiftright("__at", 33))
    # As many rows as the sort had partitions.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(parts), "__part").withColumn("__number", F.col("__before") + inside).drop("__part", "__before", "__at")
    if not group:
        return numbered.withColumnRenamed("__number", "ix").withColumns({"n": F.lit(placed.count()), "tree": F.lit(-1).cast("long")}), written
    trees = cut(numbered.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.min("__number").alias("tree"), F.count("*").alias("n")), "trees")
    side = F.broadcast(trees) if trees.count() <= MOST_KEYS else trees
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    return numbered.join(side, same).withColumn("ix", F.col("__number") - F.col("tree")).drop("__number", *[f"__{g}" for g in group]), written


def _block_of(levels: int) -> Column:
    return F.expr(f"ix div {WIDTH**levels}").alias("block")


def _opened(rows: pa.Table, levels: int) -> tuple[pa.Table, Block]:
    """The rows of one block in their order, and its tree."""
    rows = rows.sort_by("ix")
    leaves = [x.encode() for x in rows["node"].to_pylist()]
    return rows, Block(leaves, min(height_of(rows["n"][0].as_py()), levels))


def _tiers(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (tree, ix, n, node), each of the roots of the blocks of the one before; in the last each tree has one node."""

    size = WIDTH**levels

    def root(rows: pa.Table) -> pa.Table:
        rows, block = _opened(rows, levels)
        n = -(-rows["n"][0].as_py() // size)
        return pa.table({"tree": rows["tree"][:1], "ix": [rows["ix"][0].as_py() // size], "n": [n], "node": [block.root.decode()]})

    tiers = [leaves]
    while len(tiers) == 1 or not tiers[-1].where("n > 1").isEmpty():
        nodes = tiers[-1].select("tree", "ix", "n", "node").groupBy("tree", _block_of(levels)).applyInArrow(root, "tree long, ix long, n long, node string")
        tiers.append(cut(nodes, "tier"))
    return tiers


PATH = "tree long, ix long, path array<struct<left: binary, right: binary>>, subroot string, root string"


def _paths(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """``PATH`` of the nodes of the first tier but one, from those of the last (``tops``)."""

    def down(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, block = _opened(rows, levels)
        rest = above["path"][0].as_py()
        steps = [[{"left": a, "right": b} for a, b in block.path(k)] + rest for k in range(len(rows))]
        kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        texts = {c: pa.array([above[c][0].as_py()] * len(rows), pa.string()) for c in ("subroot", "root")}
        return pa.table({"tree": rows["tree"], "ix": rows["ix"], "path": pa.array(steps, kind), **texts})

    paths = tops
    for nodes in reversed(tiers[:-1]):
        paths = cut(_met(nodes, paths, down, PATH, levels), "paths")
    return paths


def _met(nodes: DataFrame, paths: DataFrame, fold, schema: str, levels: int) -> DataFrame:
    """``fold`` over each block of ``nodes`` and the one path of its root."""
    blocks = nodes.withColumn("block", _block_of(levels)).groupBy("tree", "block")
    return blocks.cogroup(paths.groupBy("tree", F.col("ix").alias("block"))).applyInArrow(fold, schema)


def manifest(docs: DataFrame, replaced: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs`` (``FIELDS``).

    ``replaced`` gives other values for some fields: each row's ``folded_root`` is
    what the root would be if these stood in that row alone.
    """
    now = {f: F.col(f) for f in FIELDS}
    then = now | (replaced or {})
    leaf, other = leaf_of(list(now.values())), leaf_of(list(then.values()))
    read = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf.alias("node"), (other if replaced else leaf).alias("other")), "leaves")
    numbered, placed = _numbered(read, ["lang"], ["doc_id", "node"])
    leaves = cut(numbered.select("tree", "ix", "n", "doc_id", "node", "other"), "numbered")
    spent(read, placed)

    tiers = _tiers(leaves, levels)
    subroots = cut(tiers[-1].select(F.col("tree").alias("of"), "node"), "subroots")
    top = cut(_numbered(subroots, [], ["of"])[0], "top")
    over = _tiers(top, levels)
    start = over[-1].select("tree", "ix", F.array().cast("array<struct<left: binary, right: binary>>").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    of_top = _paths(over, start, levels)
    tops = top.join(of_top.select("ix", "path", "root"), "ix").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("ix"), "path", F.col("node").alias("subroot"), "root")
    paths = _paths(tiers[1:], cut(tops, "tops"), levels)

    def fold(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, block = _opened(rows, levels)
        way = Above([(s["left"], s["right"]) for s in above["path"][0].as_py()])
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        folded, proofs = [], []
        for k, node in enumerate(rows["other"].to_pylist()):
            folded.append(way.fold(block.fold(k, node.encode())).decode())
            proofs.append(sha256(b"".join(a + b for a, b in block.path(k)) + way.siblings).hexdigest())
        same = [x == root for x in folded]
        return pa.table({"doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": [subroot] * len(rows), "root": [root] * len(rows), "proof_sha256": proofs, "folded_root": folded, "verified": same})

    return _met(leaves, paths, fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", levels)


def tampered_chars(doc_id: Column, n_chars: Column) -> Column:
    """n_chars plus one where 7 divides the CRC-32 of the decimal doc_id; a null stays."""
    return F.when(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 0, n_chars.cast("decimal(20,0)") + 1).otherwise(n_chars.cast("decimal(20,0)"))
