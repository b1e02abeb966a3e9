"""Connected components of a link table, in Spark: alternating large-star and small-star steps.

Least neighbours come from a groupBy with partial sums, written before they are joined
back: the table's size lets Spark choose the join, its greatest count says whether a key
is hot, and its rows say whether only stars are left, so that no round is spent on
seeing that nothing changes.  Where a key is hot the join is split: the few nodes with
over a thousandth of all links, a thousand at most, are broadcast, so that a hot node's
links stay in the tasks where they are; all others are shuffled.  Every step's table is
written to the shared folder, so lineage stays short and a lost executor costs one step;
tables that are read no more are deleted.  Only a few numbers of each step reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def split_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner", most: int | None = None) -> DataFrame:
    """many joined with the row that `one` has for its key; keys that over a thousandth of `total` rows share, by
    counts (key, n), are broadcast, a thousand rows at most by that bound.  `most` is the greatest n if it is known."""
    bound = max(1000, total // 1000)
    if most is not None and most <= bound:
        return many.join(one, key, how)
    heavy = counts.where(F.col("n") > bound).select(key)
    if most is None and heavy.isEmpty():
        return many.join(one, key, how)
    heavy = F.broadcast(heavy)
    hot = many.join(F.broadcast(one.join(heavy, key, "left_semi")), key)
    return hot.unionByName(many.join(heavy, key, "left_anti").join(one, key, how))


def _least(links: DataFrame, total: int) -> DataFrame:
    """(u, m, n) for every u: its least v and how many it has."""
    return written(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least", total)


def _moved(links: DataFrame, least: DataFrame, most: int, total: int) -> DataFrame:
    """Every link's v tied to the least neighbour of its u."""
    to = split_join(links, least.select("u", "m"), "u", least.select("u", "n"), total, most=most)
    return to.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of the links (u, v): label is the least node of its component."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    total = now.count()
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, 2 * total)
        # A node with a lesser neighbour and another one beside it is not the tip of a star.
        rest, top = least.agg(F.count_if(F.expr("m < u and n > 1")), F.coalesce(F.max("n"), F.lit(0))).first()
        if not rest:
            drop(now)
            return least.select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
        to_self = least.withColumn("m", F.least("u", "m"))
        large = written(_moved(both.where("v > u"), to_self, top, 2 * total).distinct(), "large", total)
        drop(now)
        drop(least)
        least = _least(large, total)
        top, total = least.agg(F.max("n"), F.sum("n")).first()
        now = written(_moved(large, least, top, total).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links", 2 * total)
        drop(large)
        drop(least)
        total = now.count()
    raise RuntimeError(f"no fixed point after {most} rounds")
