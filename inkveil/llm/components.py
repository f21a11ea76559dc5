"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.session import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of edges (a long, b long): the smallest node that can be reached.

    Each round sends every node's label to its neighbours (combined before the shuffle, so a node with very many
    neighbours costs no more than their number) and then lets labels point to their own labels, which halves long
    chains. Each round is written to the shared folder.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["a"]).select("node", "component", F.least("component", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = near.join(jump, near["label"] == jump["at"]).select("node", F.least("label", "further").alias("component"), (F.least("label", "further") != near["component"]).alias("moved"))
        new = scratch.save(new, f"{name}-{turn}")
        if not new.filter("moved").limit(1).count():
            scratch.drop(f"{name}-edges", f"{name}-{turn - 1}")
            return new.select("node", "component")
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("node", "component")
