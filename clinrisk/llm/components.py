"""Connected components of a link table, by alternating star operations; links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinrisk.llm.common import landed


def connected(links: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) of every node in ``links`` (columns a, b), which are read several times.

    Each round ties a node's neighbours to the smallest node it knows, first the larger neighbours, then the others; the
    number of rounds grows with the logarithm of a component's size. A hub's links are reduced by a partial minimum and
    joined back on the hub; adaptive execution splits that join where the hub's rows are many.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while not _stars(edges):
        least = _both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # A row for each link; equal ones go with the smaller neighbours.
        larger = landed(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "links")
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = landed(smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node is tied to one smaller node, and that to none: then each component is a star around its smallest."""
    smaller = F.when(F.col("b") < F.col("a"), F.col("b"))
    nodes = _both(edges).groupBy("a").agg(F.min(smaller).alias("least"), F.max(smaller).alias("most"), F.max("b").alias("top"))
    return nodes.where("least <> most OR (least IS NOT NULL AND top > a)").agg(F.count("*")).first()[0] == 0


def components_of(rows: DataFrame, classes: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with component_id, the smallest doc_id reachable between ``classes``.

    Rows of one class have equal n_shingles, high and low; a class has those, its node, smallest doc_id (id) and number of
    copies. ``labels`` (node, label) tie classes, a class without one has its node as label, and ``links`` (a, b) tie labels.
    A row that is alone has its own doc_id, which may be NULL.
    """
    further = connected(links).select(F.col("node").alias("label"), F.col("label").alias("further"))
    # Classes that are one document and have no link need no label.
    tied = (classes.join(labels.withColumn("labelled", F.lit(True)), "node", "left").withColumn("label", F.coalesce("label", "node"))
            .join(further, "label", "left").where((F.col("copies") > 1) | F.col("labelled") | F.col("further").isNotNull())
            .withColumn("label", F.coalesce("further", "label")))
    smallest = tied.groupBy("label").agg(F.min("id").alias("component_id"))
    known = tied.join(smallest, "label").where(F.col("component_id").isNotNull()).select("n_shingles", "high", "low", "component_id")
    out = rows.join(known, ["n_shingles", "high", "low"], "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
