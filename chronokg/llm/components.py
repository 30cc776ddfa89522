"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokg.llm.common import materialize

#: A node is a hub if it has more neighbours than both the least and its share of all of them; so there are at most ``HUBS`` hubs.
HUB_LEAST, HUBS = 256, 5_000


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One star step over at most ``n_edges`` edges (a, b) with b < a; it gives no more.

    Minima are combined before the shuffle, and no neighbourhood is gathered: a
    hub's edges stay where they are and meet its minimum by a broadcast of at
    most ``HUBS`` rows; the others are joined by node.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    most = max(HUB_LEAST, 2 * n_edges // HUBS)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > most).select("a", "m"))
    rest = both.join(hubs, "a", "left_anti").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    seen = both.join(hubs, "a").unionByName(rest)
    if large:
        out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Null ends and self-loops are ignored; no edges give no rows. Rounds grow with
    the logarithm of the longest path; each ends in a checkpoint, and only a
    count and a checksum reach the driver.
    """
    now = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        tidy=True,
    )
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    for _ in range(most_rounds if before[0] else 0):
        now = materialize(_star(now, True, before[0]), tidy=True)
        now = materialize(_star(now, False, before[0]), tidy=True)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
