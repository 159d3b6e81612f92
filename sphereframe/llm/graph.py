"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphereframe.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, each once.

    Large: every node hands its smallest neighbour (or itself) to its larger neighbours.  Small: to itself and
    its smaller ones.  Minima are pre-aggregated and joined back, so no neighbourhood is ever gathered.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))  # the larger neighbours of u
        out = up.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); a component is named by its smallest id."""
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    now, last = sign(edges), None
    while now != last:
        edges = materialize(_star(materialize(_star(edges, True)), False))
        now, last = sign(edges), now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
