"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import delete, materialize


def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node of its component.

    Alternates large-star and small-star steps: each turns every neighbourhood into a star around its
    smallest member, so the edge count never grows and the number of rounds follows the logarithm of the
    longest chain.  Minima are aggregated before rows meet, so a hub's edges are never gathered in one
    task.  Loops and repeated edges are allowed; an empty list gives no rows.  Every round is written to
    the shared folder, in as many files as its edges need; ``rows`` is about how many there are at first, if known.
    """
    big = F.greatest("a", "b")
    cur = materialize(edges.where("a <> b").select(big.alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", rows)
    before, n = None, cur.count()
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node points to the smallest of its neighbourhood.
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = materialize(small.where("u <> v").distinct(), "edges", n)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        delete(cur)
        cur, n = nxt, state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = materialize(roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots", 2 * n)
    delete(cur)
    return roots
