"""Everything below a row in a table of links, by doubling.

A round joins the pairs that are known with themselves, so paths of twice the length are
found each time, and a tree of depth d takes log2(d) rounds. Each round is an equi-join
and a combinable minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def descendants(links: DataFrame, child: str, parent: str, roots: DataFrame | None = None) -> DataFrame:
    """(ancestor, descendant, depth) of every pair that links connect, at the least number of links.

    With ``roots``, one column of ids, only what lies below those, found by levels
    outwards; a root without links has no rows. A link with a null on either side, or of
    a row to itself, is passed over, and links that repeat count once. On a cycle every
    row lies below every other one, none below itself. The result is as large as the
    pairs are many, which for deep chains is the square of their length; give roots where
    not all are wanted.
    """
    step = links.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).where("ancestor <> descendant").distinct()
    step = cut(step.withColumn("depth", F.lit(1)))
    if roots is None:
        known, n, reach = step, step.count(), 1
        while True:
            # all pairs up to ``reach`` links apart are known; a longer way begins with one of just that many
            near = known.where(F.col("depth") == reach).withColumnRenamed("depth", "_first")
            rest = known.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("_to"), "depth")
            longer = near.join(rest, "descendant").where("ancestor <> _to").select("ancestor", F.col("_to").alias("descendant"), (F.col("_first") + F.col("depth")).alias("depth"))
            known = cut(known.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")))
            before, n, reach = n, known.count(), 2 * reach
            if n == before:
                return known
    found = roots.select(F.col(roots.columns[0]).alias("ancestor")).where("ancestor is not null").distinct()
    front = found.select("ancestor", F.col("ancestor").alias("at"))
    known, depth = None, 0
    while True:
        depth += 1
        reach = front.join(step.select(F.col("ancestor").alias("at"), "descendant"), "at").where("ancestor <> descendant").select("ancestor", "descendant").distinct()
        if known is not None:
            reach = reach.join(known, ["ancestor", "descendant"], "leftanti")
        reach = cut(reach.withColumn("depth", F.lit(depth)))
        if reach.isEmpty():
            return known if known is not None else reach
        known = reach if known is None else cut(known.unionByName(reach))
        front = reach.select("ancestor", F.col("descendant").alias("at"))
