"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows get the numbers 0 to n-1 in an order that depends on the rows alone (hash
bucket, then doc_id, then digest and size of the text), never on files,
partitions or executors.  A keyed Feistel network permutes a rectangle of at
least n numbers; a number that falls outside 0 to n-1 walks on along its cycle.
The place p in the shuffled order then gives ``shard = p mod shards`` and
``slot = p div shards``, so the counts of two shards differ by one at most and
slots have no gaps.  ``place_of`` computes the same for any single number.

Only doc_id, size and digest are shuffled, never texts.  A bucket holds one part
in ``BUCKETS`` of the documents; copies have doc_ids of their own and spread out.

Cases: a null text has size 1 and the digest of nothing; rows that are equal in
doc_id, size and digest are counted, not gathered, and get successive numbers
(which of them gets which can't be told from the result); a very long text counts
by its size like any other; an empty table gives no rows; a null doc_id sorts
first; extra columns are ignored, and ``write_shards`` keeps them but for those
named shard and slot, which it sets, and names that begin with ``__``.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.llm.common import cut, spent

BUCKETS = 8192
ROUNDS = 6
KEY = 0x5EED
#: Steps of a walk.  A rectangle has fewer than sqrt(n)+1 numbers outside, so for
#: n up to 4096 no walk is longer; beyond, a walk goes on with probability below
#: 1/sqrt(n) at each step, and 64 steps outside don't happen (under 1e-100).
WALK = 64


def _mix(x: Column, turn: Column, key: int) -> Column:
    return F.xxhash64(F.lit(key), turn, x)


def _feistel(v: Column, a: int, b: int, key: int) -> Column:
    """Permute 0 to a*b-1: v is (v div b, v mod b); each round shifts one half by a keyed hash of the other."""
    start = F.struct(F.floor(v / F.lit(b)).cast("long").alias("l"), (v % F.lit(b)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        left = F.struct(F.pmod(l + F.pmod(_mix(r, i, key), F.lit(a)), F.lit(a)).cast("long").alias("l"), r.alias("r"))
        right = F.struct(l.alias("l"), F.pmod(r + F.pmod(_mix(l, i, key), F.lit(b)), F.lit(b)).cast("long").alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def place_of(number: Column, n: int, key: int = KEY) -> Column:
    """The place of row ``number`` (0 to n-1) in the shuffled order."""
    a = isqrt(max(n, 1) - 1) + 1
    b = -(-max(n, 1) // a)
    step = lambda v, i: F.when((i == 1) | (v >= F.lit(n)), _feistel(v, a, b, key)).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), number.cast("long"), step)


LOOK = ["doc_id", "size", "text_crc32"]


def _look(docs: DataFrame, *more: str) -> DataFrame:
    """What tells the rows of ``docs`` apart: doc_id, size and digest of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *more,
    )


def _placed(rows: DataFrame, n_shards: int, key: int) -> DataFrame:
    """doc_id, size, text_crc32, copy, shard, slot: a place for each row of ``rows`` (written once); copy counts equal rows from 0."""
    equal = rows.groupBy(*LOOK).agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int"))
    equal = cut(equal, "numbered")
    counts = equal.groupBy("bucket").agg(F.sum("n").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    # As many rows as there are buckets, whatever the input.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        equal.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "bucket")
        .select(*LOOK, (F.col("offset") + F.col("start")).alias("number"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
        .withColumn("place", place_of(F.col("number") + F.col("copy"), n, key))
    )
    return numbered.select(
        *LOOK, "copy", F.pmod("place", F.lit(n_shards)).cast("int").alias("shard"), F.floor(F.col("place") / F.lit(n_shards)).cast("long").alias("slot")
    )


def shards(docs: DataFrame, n_shards: int, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text).

    The law is ``rows``: the counts of the shards are at most one apart.
    """
    placed = _placed(_look(docs), n_shards, key)
    return placed.select(*LOOK, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, n_shards: int, path: str, key: int = KEY) -> None:
    """Write ``docs`` as folders shard=0, 1, ... whose files hold runs of slots.

    A shard is dealt to as many tasks as its rows need, by ranges of slots; no
    task gets a whole shard.
    """
    inner = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = cut(docs.select(*[F.col(f"`{c}`") for c in inner]).withColumn("__row", F.monotonically_increasing_id()), "rows")
    # Equal rows count up within their file split, then across splits.
    look = _look(rows, "__row").withColumn("part", F.shiftright("__row", 33))
    split = Window.partitionBy(*LOOK, "part")
    before = Window.partitionBy(*LOOK).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = look.groupBy(*LOOK, "part").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = look.withColumn("inside", F.row_number().over(split.orderBy("__row")) - 1).alias("a")
    counted = at.join(parts.alias("p"), [F.col(f"a.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*LOOK, "part")]).select(
        *[f"a.{c}" for c in LOOK], "a.__row", (F.col("earlier") + F.col("inside")).alias("copy")
    )
    placed = _placed(_look(rows), n_shards, key)
    found = counted.alias("c").join(placed.alias("q"), [F.col(f"c.{c}").eqNullSafe(F.col(f"q.{c}")) for c in (*LOOK, "copy")]).select("__row", "shard", "slot")
    rows.join(found, "__row").drop("__row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    spent(rows)
