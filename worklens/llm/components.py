"""Connected components of a table of links by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, comp), comp the smallest node of the component; nodes without links have no row.

    Each round maps every node to its smallest neighbour (or itself) and keeps the links between the images. Nodes are
    hashes, so the images are a fraction of the nodes and the rounds grow with the logarithm of their number. Every
    round ends in a table; nothing but counts comes to the driver. Self links and repeated links change nothing.
    """
    edges = materialise(links.select("a", "b").filter("a <> b").distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to")), "step")
        steps.append(step)
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(a, "a").join(b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = materialise(moved.filter("a <> b").distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    labels = steps[-1].select("node", F.col("to").alias("comp"))
    for step in reversed(steps[:-1]):
        later = labels.withColumnRenamed("node", "to")
        labels = step.join(later, "to", "left").select("node", F.coalesce("comp", "to").alias("comp"))
    # images that are local minima may still point further; a label's own label is final
    return materialise(labels, "components")


def more_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) of ``components`` brought up to date with further (a, b) links: only links between different components are worked on."""
    a, b = (found.select(F.col("node").alias(x), F.col("comp").alias("comp_" + x)) for x in "ab")
    comp_a, comp_b = F.coalesce("comp_a", "a"), F.coalesce("comp_b", "b")
    moved = links.join(a, "a", "left").join(b, "b", "left").select(F.least(comp_a, comp_b).alias("a"), F.greatest(comp_a, comp_b).alias("b"))
    merged = components(moved)
    new = merged.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
    both = found.unionAll(new).join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left")
    return materialise(both.select("node", F.coalesce("now", "comp").alias("comp")), "components")
