"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textjobs.sources.files import save_and_reread


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge: the least node it is
    connected to.  Labels take the least label of their neighbours, then the
    label of their label, until none changes; every round is one written
    table, and neighbours are reduced inside tasks before they are shuffled.
    Self-edges give a component of one node; no edge gives an empty table."""
    edge = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    least = edge.groupBy("u").agg(F.min("v").alias("m"))
    # every edge to a smaller node goes by way of the smallest such node: as
    # connected as before, and nodes with equal neighbours share their edges
    star = edge.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    star = save_and_reread(star.select("e.*").distinct(), "star")
    pairs = save_and_reread(star.union(star.select("v", "u")).distinct(), "edges")
    labels = save_and_reread(
        pairs.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == total:
            return labels
        total = now
        near = pairs.join(labels, pairs["u"] == labels["node"]).select(F.col("v").alias("node"), "component")
        least = near.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        least = save_and_reread(least, "labels")
        up = least.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels = save_and_reread(
            least.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component")), "labels")
