"""Connected components of links, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.sizing import staged


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (src, dst): root is the smallest node it reaches, itself included.

    Alternates two steps until nothing changes: every node is linked to the smallest neighbour
    of its smaller neighbour (large star), then all its smaller neighbours to the smallest of them (small star).
    Links never grow in number, a node with many neighbours is only a group with a minimum,
    and every round is written to the shared folder, so nothing long has to be computed again.
    Self links count as nodes; an empty table gives an empty one.
    """
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    edges = staged(
        links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(), "links")
    state = _sum(edges)
    while state[0]:
        smallest = edges.groupBy("src").agg(F.min("dst").alias("low"))
        jumped = edges.join(smallest.select(F.col("src").alias("dst"), "low"), "dst", "left").select(
            "src", F.coalesce("low", "dst").alias("dst")).distinct()
        lowest = jumped.groupBy("src").agg(F.min("dst").alias("low"))
        pulled = jumped.join(lowest, "src").where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        edges = staged(pulled.union(lowest.select("src", F.col("low").alias("dst"))).distinct(), "links")
        now = _sum(edges)
        if now == state:
            break
        state = now
    return nodes.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
    return row[0], row[1]
