"""Connected components by alternating large and small stars over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm._shared import cut, forget


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours v, for edges (u, v)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them; edges have u > v."""
    low = _least(edges)
    tied = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); component is its smallest node.

    A step shuffles links only; each round is written to the shared folder, and rounds end when
    the links no longer change: every node then has one, to its component's smallest.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        large = cut(_large(edges), "large")
        forget(edges)
        edges = cut(_small(large), "small")
        forget(large)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
