"""Repair of conversation structure by a Viterbi search that emits as it goes.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Edits, in the order
of the rows: Keep a row (0), Rerole it to user or assistant (2), Delete it (3,
required for blank and duplicate rows), Insert an empty user or assistant row (2);
a truncated row that is not deleted adds 1.  Of the cheapest edit strings the least
in ASCII order is taken.

The search has four states, by what the output ends with: nothing, system, user,
assistant.  Each state's survivor (its cheapest, then least, edit string) is a leaf
of a backpointer tree whose nodes count their references: a node that no survivor
needs goes, and once all survivors share the node below the root, its edits are
emitted and its row is let go.  A state is dropped when another is cheaper by more
than any continuation can make up, so one long deletion doesn't hold the tree.
What is held are the rows on which survivors still differ.  Tied strings are
compared whole: two survivors either differ at some place, which decides for all
that may follow, or one is the other with insertions after it, which are compared
with what follows; both are carried from row to row, so a tie costs no walk back.

Rows are dealt by conversation in one shuffle and sorted (both spill); a
conversation runs through its task batch by batch and is never gathered.  It stays
in one task whatever its length, as its digest is one running hash.

Cases: null roles and texts are one space; rows of a null conv_id are one
conversation; turns sort nulls first, then by role and text; rows that share a turn
or are equal are rows each; an empty role has no initial; a very long text counts
whole, a conversation without rows is not in the table, one whose rows are all
marked as dropped has an empty result; an empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clausework.llm.common import small_batches

# White space, ends of sentences, roles, costs.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
USER, ASSISTANT = "user", "assistant"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

EMPTY, SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: The state after a role's initial.
NEXT = {
    (EMPTY, "s"): SYSTEM,
    (EMPTY, "u"): AFTER_USER,
    (SYSTEM, "u"): AFTER_USER,
    (AFTER_USER, "a"): AFTER_ASSISTANT,
    (AFTER_ASSISTANT, "u"): AFTER_USER,
}
ACCEPTED = (EMPTY, AFTER_ASSISTANT)
#: What any continuation of the first state costs more, at most, from the second.
DETOUR = {
    (EMPTY, SYSTEM): 4, (EMPTY, AFTER_USER): 5, (EMPTY, AFTER_ASSISTANT): 3,
    (SYSTEM, EMPTY): 0, (SYSTEM, AFTER_USER): 2, (SYSTEM, AFTER_ASSISTANT): 0,
    (AFTER_USER, EMPTY): 2, (AFTER_USER, SYSTEM): 2, (AFTER_USER, AFTER_ASSISTANT): 2,
    (AFTER_ASSISTANT, EMPTY): 0, (AFTER_ASSISTANT, SYSTEM): 4, (AFTER_ASSISTANT, AFTER_USER): 2,
}


def given_role(state: int) -> str:
    """The role that Rerole or Insert gives after ``state``: the grammar leaves one."""
    return ASSISTANT if state == AFTER_USER else USER


def _step(state: int, edit: str, initial: str) -> int | None:
    if edit == "D":
        return state
    return NEXT.get((state, initial if edit == "K" else given_role(state)[0]))


@cache
def moves(initial: str, must_delete: bool, truncated: bool) -> list[tuple[int, str, int, int]]:
    """(state, edits, next state, cost) of one row with up to two insertions after it."""
    found = []
    row = [("D", DELETE)] if must_delete else [("D", DELETE), ("K", truncated * TRUNCATED), ("R", REROLE + truncated * TRUNCATED)]
    for state in range(4):
        for edit, cost in row:
            to, edits = _step(state, edit, initial), edit
            for _ in range(3):
                if to is None:
                    break
                found.append((state, edits, to, cost))
                to, edits, cost = _step(to, "I", ""), edits + "I", cost + INSERT
    return found


class Node:
    """A survivor's edits at one row, and how many nodes and survivors need them."""

    __slots__ = ("parent", "edits", "row", "refs", "last")

    def __init__(self, parent: Node | None, edits: str, row: tuple[str, str] | None) -> None:
        self.parent, self.edits, self.row, self.refs, self.last = parent, edits, row, 0, None
        if parent is not None:
            parent.refs += 1
            parent.last = self


class Search:
    """The search over one conversation; ``emit(edit, role, text)`` gets each edit as soon as it is certain."""

    def __init__(self, emit: Callable[[str, str, str], None]) -> None:
        self.emit, self.state = emit, EMPTY
        self.root = Node(None, "", None)
        self.tips: dict[int, Node] = {}
        self.costs: dict[int, int] = {}
        #: For two survivors: -1 or 1 if they differ, else the insertions that the second has after the first.
        self.order: dict[tuple[int, int], int | str | None] = {}
        start = [(EMPTY, "", EMPTY, 0), (EMPTY, "I", AFTER_USER, INSERT), (EMPTY, "II", AFTER_ASSISTANT, 2 * INSERT)]
        self.costs, self.order = {EMPTY: 0}, {(EMPTY, EMPTY): ""}
        self.tips = {EMPTY: self.root}
        self.root.refs += 1
        self._take(start, None)

    def _compare(self, p: int, w: str, q: int, v: str) -> int | str | None:
        """As ``order``, for survivor p and the edits w against survivor q and the edits v; None: the first is longer."""
        known = self.order[p, q]
        if known is None:
            w = self.order[q, p] + w
        elif isinstance(known, str):
            v = known + v
        else:
            return known
        if v.startswith(w):
            return v[len(w) :]
        if w.startswith(v):
            return None
        return -1 if w < v else 1

    def _less(self, one: tuple[int, str], other: tuple[int, str]) -> bool:
        found = self._compare(*one, *other)
        return found == -1 or isinstance(found, str) and found != ""

    def _take(self, options: list[tuple[int, str, int, int]], row: tuple[str, str] | None) -> None:
        best: dict[int, tuple[int, int, str]] = {}
        for state, edits, to, cost in options:
            if state in self.costs:
                total = self.costs[state] + cost
                held = best.get(to)
                if held is None or total < held[0] or total == held[0] and self._less((state, edits), held[1:]):
                    best[to] = (total, state, edits)
        for a in list(best):
            if any(a != b and best[a][0] > best[b][0] + DETOUR[a, b] for b in best):
                del best[a]
        order = {(a, b): self._compare(*best[a][1:], *best[b][1:]) for a in best for b in best}
        tips = {a: Node(self.tips[state], edits, None if edits[:1] == "D" else row) for a, (_, state, edits) in best.items()}
        for n in tips.values():
            n.refs += 1
        for n in self.tips.values():
            self._release(n)
        self.tips, self.costs, self.order = tips, {a: b[0] for a, b in best.items()}, order
        self._coalesce()

    def _release(self, node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            node = node.parent

    def _coalesce(self) -> None:
        """Emit the edits of nodes that all survivors share."""
        while self.root.refs == 1 and self.root not in self.tips.values():
            child = self._only_child()
            self._emit(child)
            child.parent = None
            self.root = child

    def _only_child(self) -> Node:
        # The last child made is the one that is left unless it was released; then any survivor leads to it.
        if self.root.last is not None and self.root.last.refs and self.root.last.parent is self.root:
            return self.root.last
        node = next(iter(self.tips.values()))
        while node.parent is not self.root:
            node = node.parent
        self.root.last = node
        return node

    def _emit(self, node: Node) -> None:
        for edit in node.edits:
            role, text = ("", "") if edit in "DI" else node.row
            to = _step(self.state, edit, role[:1])
            self.emit(edit, role if edit in "KD" else given_role(self.state), text)
            self.state = to

    def row(self, role: str, text: str, must_delete: bool, truncated: bool) -> None:
        self._take(moves(role[:1], must_delete, truncated), (role, "" if must_delete else text))

    def end(self) -> int:
        """Emit what is left; the cost of all edits."""
        found = None
        for state in ACCEPTED:
            if state in self.costs and (found is None or self.costs[state] < self.costs[found] or self.costs[state] == self.costs[found] and self._less((state, ""), (found, ""))):
                found = state
        rest, node = [], self.tips[found]
        while node is not self.root:
            rest.append(node)
            node = node.parent
        for n in reversed(rest):
            self._emit(n)
        return self.costs[found]


ROWS = ["conv_id", "turn", "role", "text", "dropped", "blank", "duplicate", "truncated"]


def judged(rows: DataFrame) -> DataFrame:
    """``ROWS``: each row of ``rows`` (conv_id, turn, role, text, dropped) with its first fault, dealt by conversation, in order.

    One shuffle; the window and the order need no other.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), "dropped").repartition("conv_id")
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "key").orderBy(F.col("turn").asc_nulls_first()))
    blank = (ended == "") & ~F.col("dropped")
    duplicate = ~blank & (F.col("seen") > 1) & ~F.col("dropped")
    last = F.substring(ended, -1, 1)
    found = (
        dealt.withColumn("key", key)
        .withColumn("seen", seen)
        .withColumns({"blank": blank, "duplicate": duplicate, "truncated": ~blank & ~duplicate & ~F.col("dropped") & ~last.isin(*ENDS)})
    )
    return found.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen").select(*ROWS)


def _streamed(rows: DataFrame, sink: Callable, schema: str) -> DataFrame:
    """Run each conversation through a search; ``sink()`` makes what takes its rows and edits and gives rows of ``schema``."""
    small_batches(rows.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last, out = None, None, []

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(cols)], schema=kinds)

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or conv != last:
                    if open_ is not None:
                        open_.close(out)
                    open_, last = sink(conv), conv
                open_.row(*row, out)
            yield made()
            out.clear()
        if open_ is not None:
            open_.close(out)
            yield made()

    return judged(rows).mapInArrow(run, schema)


class Audit:
    """Counts, edits and the digest of one conversation, kept as they come."""

    def __init__(self, conv) -> None:
        self.conv, self.counts = conv, {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.least = self.most = self.turn = None
        self.turns, self.before = 0, None
        self.edits, self.digest, self.lines = [], sha256(), 0
        self.search = Search(self._edit)

    def _edit(self, edit: str, role: str, text: str) -> None:
        self.edits.append(edit)
        if edit != "D":
            self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
            self.lines += 1

    def row(self, turn, role, text, dropped, blank, duplicate, truncated, out) -> None:
        if dropped:
            return
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.least, self.most = turn if self.least is None else self.least, turn
        self.counts["blank"] += blank
        self.counts["duplicate"] += duplicate
        self.counts["truncated"] += truncated
        if self.before is not None:
            self.counts["illegal"] += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.search.row(role, text, blank or duplicate, truncated)

    def close(self, out: list) -> None:
        cost = self.search.end()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        out.append((self.conv, gaps, *self.counts.values(), cost, "".join(self.edits), self.digest.hexdigest()))


class Lines:
    """The repaired rows of one conversation, each as soon as it is certain."""

    def __init__(self, conv) -> None:
        self.conv, self.ix, self.out = conv, 0, []
        self.search = Search(self._edit)

    def _edit(self, edit: str, role: str, text: str) -> None:
        if edit != "D":
            self.out.append((self.conv, self.ix, edit, role, text))
            self.ix += 1

    def row(self, turn, role, text, dropped, blank, duplicate, truncated, out) -> None:
        if not dropped:
            self.search.row(role, text, blank or duplicate, truncated)
            out += self.out
            self.out.clear()

    def close(self, out: list) -> None:
        self.search.end()
        out += self.out


def _with_dropped(rows: DataFrame, dropped: str | None) -> DataFrame:
    return rows.select("conv_id", "turn", "role", "text", (F.lit(False) if dropped is None else F.col(dropped)).alias("dropped"))


def audits(rows: DataFrame, dropped: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows`` (conv_id, turn, role, text).

    Rows that the boolean column ``dropped`` marks count for nothing but their conversation's being there.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _streamed(_with_dropped(rows, dropped), Audit, schema)


def repaired(rows: DataFrame, dropped: str | None = None) -> DataFrame:
    """conv_id, ix, edit, role, text: the rows of the repaired conversations."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _streamed(_with_dropped(rows, dropped), Lines, f"conv_id {kind}, ix long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted faults, by the CRC-32 of ``conv_id:turn``: the first row in twenty of them dropped, and so on."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(F.col("kind") == 4, F.lit(USER)).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("copy")).drop("copy")
