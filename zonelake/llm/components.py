"""Connected components by contraction, on links only and without collecting any of them.

Defined results: links of a node with itself or with a null are dropped, repeated and reversed ones count once; no links
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonelake.llm.common import Shelf

#: Rounds in which the smallest id attracts its neighbours; later ones draw lots, so that long paths halve as well.
BY_ID = 3


def components(links: DataFrame) -> DataFrame:
    """(v, component) for every node of the links (a, b): the smallest id that can be reached.

    Each round maps a node to the first of itself and its neighbours in the order of that round, then maps the links
    along and drops those that became loops. Minima are aggregated before the shuffle, so a node with very many links
    costs no more than its links; joins have a fresh exchange on both sides, which lets Spark split hot keys.
    """
    shelf = Shelf(links.sparkSession)
    edges = shelf.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    label, step = None, 0
    while label is None or not edges.isEmpty():

        def order(c: Column, step: int = step) -> Column:
            return F.struct(c.alias("p") if step < BY_ID else F.xxhash64(c, F.lit(step)).alias("p"), c.alias("v"))

        ends = edges.union(edges.select("b", "a"))
        first = ends.groupBy(F.col("a").alias("node")).agg(F.min(order(F.col("b"))).alias("other"))
        first = shelf.keep(first.select("node", F.least(F.col("other"), order(F.col("node")))["v"].alias("to")))
        to = lambda name: first.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))  # noqa: E731, B023
        if label is None:
            label = first.select(F.col("node").alias("v"), F.col("to").alias("component"))
        else:
            label = label.join(to("component"), "component", "left").select("v", F.coalesce("component_to", "component").alias("component"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = shelf.keep(moved.where("a <> b").distinct())
        step += 1
        if step % BY_ID == 0:
            label = shelf.keep(label)
    if step > BY_ID:
        label = shelf.keep(label)
        smallest = label.groupBy("component").agg(F.min("v").alias("smallest"))
        label = label.join(smallest, "component").select("v", F.col("smallest").alias("component"))
    return shelf.last(label)


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (v, component) after further links (a, b); only what the links touch is worked on."""
    if labels is None:
        return components(links)

    def labelled(rows: DataFrame, name: str) -> DataFrame:
        found = labels.select(F.col("v").alias(name), F.col("component").alias("__component"))
        return rows.join(found, name, "left").withColumn(name, F.coalesce("__component", name)).drop("__component")

    moved = components(labelled(labelled(links, "a"), "b").select("a", "b"))
    to = moved.select(F.col("v").alias("component"), F.col("component").alias("__to"))
    old = labels.join(to, "component", "left").select("v", F.coalesce("__to", "component").alias("component"))
    return old.union(moved.join(labels, "v", "left_anti").select("v", "component"))
