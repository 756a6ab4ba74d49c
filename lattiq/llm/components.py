"""Connected components of a table of links, by repeated contraction.

In each round every node joins the neighbour (or itself) with the smallest hash of that
round; links are renamed and those inside a node go.  A constant share of the nodes goes
in each round, long chains included.  All steps are joins and aggregates on node keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.  links: columns a, b."""
    edges = scratch.keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(steps) + 1
        both = edges.select("a", "b").union(edges.select("b", "a"))
        rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("to"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a")).getField("to").alias("to"))
        step = scratch.keep(least, f"{name}-step{k}")
        one = edges.join(step, edges["a"] == step["node"]).select(F.col("to").alias("a"), "b")
        two = one.join(step, one["b"] == step["node"]).select("a", F.col("to").alias("b"))
        edges = scratch.keep(two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-{k}")
        steps.append(step)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = steps[0].select("node", "to")
    for step in steps[1:]:
        at = at.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    at = scratch.keep(at, f"{name}-roots")
    least = at.groupBy("to").agg(F.min("node").alias("component"))
    out = scratch.keep(at.join(least, "to").select("node", "component"), name)
    scratch.drop(f"{name}-0", f"{name}-roots", *(f"{name}-{x}{k}" for k in range(1, len(steps) + 1) for x in ("step", "")))
    return out
