"""Connected components of a table of links, by large-star and small-star rounds.

Each round relinks every node to the least of its neighbourhood; the number of rounds grows with the logarithm of a
component's diameter.  All state is a table of links: nothing is collected.  A round ends in a table written
to the shared folder.  A node's links are dealt to `SALTS` shares, so that no task holds all links of a node that has very many.

Cases: an empty table, or one of null ends only, gives no rows; repeated links count once; a loop alone is a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import saved


#: Shares to which the links of a node are dealt.
SALTS = 16


def _with_least(links: DataFrame) -> DataFrame:
    """u, v, m: m is the least v of each u."""
    dealt = links.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    shares = dealt.groupBy("u", "share").agg(F.min("v").alias("m"))
    least = shares.groupBy("u").agg(F.min("m").alias("m"))
    return dealt.join(shares.select("u", "share").join(least, "u"), ["u", "share"]).select("u", "v", "m")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (its least node) for every node of a link; loops are nodes of their own.  Links with a null end are
    left out.  More rounds than `rounds` are an error (a path of 2^60 nodes might take them), never a partial result."""
    every = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    edges = saved(every.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        # large-star: every greater neighbour of u is linked to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small-star: the lesser neighbours of u and u itself are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    labelled = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = every.filter("a = b").select(F.col("a").alias("node")).distinct()
    found = labelled.unionByName(roots)
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
