"""Connected components of an undirected graph given as a frame of edges, and joins that hot keys don't hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A key is hot that has more than this share of all rows, and more than HOT_ROWS of them; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 1 / 4096, 256


def join_facts(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with facts (one row a key, `n`: how many of the `total` rows have it); n is left out.

    The facts of hot keys are few, whatever the size of the input, and are
    broadcast; all other keys are shuffled and have few rows each.
    """
    limit = max(HOT_ROWS, total * HOT_SHARE)
    hot = F.broadcast(facts.filter(F.col("n") > limit).drop("n"))
    cold = rows.join(F.broadcast(facts.filter(F.col("n") > limit).select(key)), key, "left_anti").join(facts.filter(F.col("n") <= limit).drop("n").hint("shuffle_merge"), key)
    return cold.unionByName(rows.join(hot, key))


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) of every node but the roots, from bigint columns a and b.

    Alternates large-star and small-star steps: every node hands its larger
    (smaller) neighbours to its least one. A hub's neighbours are reduced by
    min() before they are shuffled and joined back by join_facts, never
    gathered. Lineage is cut after every round; rounds go on until nothing
    changes, at most about the square of log2 of the nodes. Self-loops and edges
    with nulls count as nothing.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct()
    now, before = materialize(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_facts(both.filter("v > u"), least, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_facts(large, down, "u", state[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "edges")
