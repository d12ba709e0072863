"""Following pointers by doubling: a path of n steps takes log2 n rounds of joins.

``pointers``: key, node, to; a node has one row at most.  Each round is written
to the shared folder, and only a count of it comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.sources.shared import cut

#: Steps of a path that are written round by round before places are looked for that it meets again.
APPENDED = 16


def doubled(jump: DataFrame, key: str) -> DataFrame:
    """Pointers of twice the length; a node whose path ends before has none."""
    further = jump.select(key, F.col("node").alias("to"), F.col("to").alias("next"))
    return jump.join(further, [key, "to"]).select(key, "node", F.col("next").alias("to"))


def within(found: DataFrame, key: str, cap: int) -> DataFrame:
    """``found`` (key, start, ix, at) without starts that earlier ones leave nothing of ``cap`` places to.

    Counts only grow, so a start that is out of reach now stays so.
    """
    many = found.where("ix > 0").groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cap).select(key)
    if many.isEmpty():
        return found
    counts = found.join(many, key, "left_semi").groupBy(key, "start").agg(F.count_if(F.col("ix") > 0).alias("n"))
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") >= cap).select(key, "start")
    return cut(found.join(out, [key, "start"], "left_anti"), "orbit")


def orbits(pointers: DataFrame, starts: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """key, start, ix, at: every place that a start (key, start) leads to, once, at its first step; the start itself is step 0.

    A circle is walked once: a place that is met again keeps its first step.  Paths that end within ``APPENDED`` steps meet
    no place twice, so a round writes only what is new; what goes on for longer may run in a circle, and from there on each
    round is gathered by place.  With ``cap``, starts are dropped in each
    round once those before them in their key have that many places, so no round holds more than about twice as many a key.
    """
    jump = cut(pointers.where("to is not null").select(key, "node", "to").distinct(), "jump")
    found = cut(starts.select(key, "start", F.lit(0).alias("ix"), F.col("start").alias("at")).distinct(), "orbit")
    n, step = -1, 1
    while True:
        on = found.join(jump.withColumnRenamed("node", "at"), [key, "at"]).select(key, "start", (F.col("ix") + step).alias("ix"), F.col("to").alias("at"))
        if cap is None and step <= APPENDED:
            on = cut(on, "orbit")
            if on.isEmpty():
                return found
            found, step = found.unionByName(on), 2 * step
            jump = cut(doubled(jump, key), "jump")
            continue
        found = cut(found.unionByName(on).groupBy(key, "start", "at").agg(F.min("ix").alias("ix")).select(key, "start", "ix", "at"), "orbit")
        more = found.count()
        if more == n:
            return found
        if cap is not None:
            found = within(found, key, cap)
            more = found.count()
        n, step = more, 2 * step
        jump = cut(doubled(jump, key), "jump")


def circles(pointers: DataFrame, key: str) -> DataFrame:
    """key, node: the nodes that come back to themselves.

    What is reached by 2**k steps from anywhere shrinks with k until only circles
    are left; once doubling takes nothing away, the steps permute what is left.
    """
    jump = cut(pointers.where("to is not null").select(key, "node", "to"), "jump")
    n = -1
    while True:
        reached = jump.select(key, F.col("to").alias("node")).distinct()
        left = reached.count()
        if left == n:
            return reached
        n = left
        jump = cut(doubled(jump, key), "jump")
